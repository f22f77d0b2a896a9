"""Queries of grouped vector analytics, with oracle SQL where labels are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import cluster as K
from curatrix.operators import modes as M
from curatrix.operators import vectors as V
from curatrix.session import table

QUERIES, SQL = {}, {}
C = F.col
IPC = 5


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _rows(s, d):
    return table(s, d, "embeddings").withColumn("cls", C("label") % 3)


_L2 = "sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
_BASE = f"""with e as (select vec_id, label % 3 cls, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
u as (select cls, label, i.i, avg(v[i.i]) m from e, (select unnest(range(1, (select max(len(embedding)) from embeddings) + 1)) i) i group by all),
c as (select cls, label, list(m order by i) c from u group by all),
dist as (select e.vec_id, e.cls, e.label, round({_L2.format(a="v", b="c")}, 6) d from e join c using (cls, label)),
stat as (select cls, label, arg_min(vec_id, struct_pack(d := d, i := vec_id)) medoid, count(*) num_members, round(1 / greatest(avg(d), 1e-8), 4) density from dist group by all),
st as (select *, round(num_members / sum(num_members) over (partition by cls), 4) weight from stat)"""


def _med(s, d):
    return V.mode_stats(V.medoids(_rows(s, d), ["cls", "label"], "vec_id"), "cls")


_add("medoid", lambda s, d: _med(s, d).select("cls", "label", "medoid"), f"{_BASE} select cls, label, medoid from st")
_add("mode_stats", lambda s, d: _med(s, d).select("cls", "label", "num_members", "weight", "density"), f"{_BASE} select cls, label, num_members, weight, density from st")
_NOISE = f"{_BASE}, pairs as (select e.vec_id, e.cls, c.label, round({_L2.format(a='v', b='c')}, 6) d from e join c using (cls))"
_add("noise_reassign", lambda s, d: V.nearest(_rows(s, d), V.centroids(_rows(s, d), ["cls", "label"]), "cls", "label", "vec_id"), f"{_NOISE} select vec_id, cls, arg_min(label, struct_pack(d := d, l := label)) as label from pairs group by all")
_FEW = "label < 6"
_add(
    "absorb_unselected",
    lambda s, d: V.nearest(V.centroids(_rows(s, d), ["cls", "label"]).filter("label >= 6").select("cls", C("label").alias("mode"), C("centroid").alias("embedding")), V.centroids(_rows(s, d), ["cls", "label"]).filter(_FEW), "cls", "label", "mode"),
    f"{_BASE}, p as (select a.cls, a.label mode, b.label, round({_L2.format(a='a.c', b='b.c')}, 6) d from c a join c b using (cls) where a.label >= 6 and b.label < 6) select mode, cls, arg_min(label, struct_pack(d := d, l := label)) as label from p group by all",
)
_SIZES = "sizes as (select label % 3 cls, label, count(*) n from embeddings group by all)"
_QUOTA = f"""with {_SIZES}, q as (select *, count(*) over w k, row_number() over (partition by cls order by label) r, n / sum(n) over w * ({{ipc}} - count(*) over w) x from sizes window w as (partition by cls)),
t as (select *, {{ipc}} - k - sum(floor(x)) over (partition by cls) rest, row_number() over (partition by cls order by round(x - floor(x), 9) desc, label) turn from q)
select cls, label, n, cast(case when k >= {{ipc}} then cast(r <= {{ipc}} as int) else 1 + floor(x) + case when turn <= rest then 1 else 0 end end as int) quota from t"""
_sizes = lambda s, d: _rows(s, d).groupBy("cls", "label").agg(F.count("*").alias("n"))
_add("quota_allocation", lambda s, d: V.quota_allocation(_sizes(s, d), "cls", "label", "n", 17), _QUOTA.format(ipc=17))
_add("quota_capped", lambda s, d: V.quota_allocation(_sizes(s, d), "cls", "label", "n", 2), _QUOTA.format(ipc=2))
_add(
    "farthest_point",
    lambda s, d: V.farthest_point(V.centroids(_rows(s, d), ["cls", "label"]), "cls", "label", 3),
    f"""{_BASE}, p as (select a.cls, a.label x, b.label y, round({_L2.format(a='a.c', b='b.c')}, 6) d from c a join c b using (cls)), t0 as (select cls, min(label) l from c group by cls),
t1 as (select p.cls, arg_max(x, struct_pack(d := d, l := -x)) l from p join t0 on t0.cls = p.cls and y = t0.l where x <> t0.l group by p.cls),
g as (select p.cls, x, min(d) d from p join (select * from t0 union all select * from t1) t on t.cls = p.cls and y = t.l group by all),
t2 as (select g.cls, arg_max(x, struct_pack(d := d, l := -x)) l from g where (g.cls, x) not in (select cls, l from t0 union all select cls, l from t1) group by g.cls)
select cls, l as label, 0 turn from t0 union all select cls, l, 1 from t1 union all select cls, l, 2 from t2""",
)
_add("renumber_clusters", lambda s, d: V.renumber(_rows(s, d).withColumn("l", C("label") * 7 - 7), "cls", "l").select("vec_id", "cluster_id"), "select vec_id, cast(case when label = 0 then 0 else dense_rank() over (partition by label % 3, label = 0 order by label) - 1 end as int) cluster_id from embeddings")
_add("modes_index", lambda s, d: V.modes_index(_med(s, d), "cls", "label").select("cls", "label", "global_mode_index", "medoid", "weight", "density"), f"{_BASE} select cls, label, row_number() over (order by cls, label) - 1 global_mode_index, medoid, weight, density from st")
_add("class_summary", lambda s, d: V.class_summary(_med(s, d), "cls"), f"{_BASE} select cls, count(*) num_clusters, cast(sum(num_members) as bigint) num_samples, string_agg(cast(num_members as varchar), ',' order by num_members) sizes from st group by cls")
_add("medoid_lookup", lambda s, d: _med(s, d).join(_rows(s, d).select(C("vec_id").alias("medoid"), C("label").alias("of")), "medoid", "left").select("medoid", "of"), f"{_BASE} select medoid, label as of from st")
_add("set_difference", lambda s, d: _sizes(s, d).select("cls", "label").join(V.farthest_point(V.centroids(_rows(s, d), ["cls", "label"]), "cls", "label", 1), ["cls", "label"], "left_anti"), "with m as (select distinct label % 3 cls, label from embeddings) select cls, label from m where label not in (select min(label) from m group by cls)")
_add("load_modes", lambda s, d: _med(s, d).join(_rows(s, d).select(C("vec_id").alias("medoid")), "medoid").select("cls", "label", "medoid", "num_members"), f"{_BASE} select cls, label, medoid, num_members from st")
# no SQL: iterative
_add("group_kmeans", lambda s, d: K.group_kmeans(_rows(s, d).withColumn("k", F.lit(IPC)), "cls", "vec_id", "k"))
_add("subcluster", lambda s, d: K.subcluster(_rows(s, d), V.quota_allocation(_sizes(s, d), "cls", "label", "n", 6), "cls", "label", "vec_id"))
_add("density_modes", lambda s, d: K.density_modes(_rows(s, d), "cls", "vec_id", IPC))
_add("discover_modes", lambda s, d: M.discover_modes(_rows(s, d), "cls", "vec_id", IPC, pca_dim=16).labels)


def _lists(diagnostics):
    """Arrays as texts, so that engines compare."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return diagnostics.select(*[text(c) if t.startswith("array") else C(c) for c, t in diagnostics.dtypes])


_add("discover_diagnostics", lambda s, d: _lists(M.discover_modes(_rows(s, d), "cls", "vec_id", IPC, pca_dim=16).diagnostics))

# Given density labels, so that another engine can follow: five modes in group 0, two in 1 and 2, one in 3; every ninth row is noise.
_GIVEN_IPC = 3
_GROUP, _FOUND = "case when label <= 4 then 0 when label <= 6 then 1 when label <= 8 then 2 else 3 end", "case when vec_id % 9 = 4 then -1 else label end"


def _given(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding", F.expr(_GROUP).alias("cls"), F.expr(_FOUND).alias("label"))
    return M.assign_modes(rows, rows.select("vec_id", "cls", "label"), "cls", "vec_id", _GIVEN_IPC)


def _centers(name, source, key):
    return f"{name}_ as (select cls, {key}, i.i, avg(v[i.i]) m from {source}, (select unnest(range(1, (select max(len(embedding)) from embeddings) + 1)) i) i group by all), {name} as (select cls, {key}, list(m order by i) c from {name}_ group by all)"


_FAR = "arg_max({x}, struct_pack(d := {d}, l := -{x}))"
_GIVEN_SQL = f"""with e as (select vec_id, {_GROUP} cls, {_FOUND} label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
seen as (select cls, label, count(*) n from e where label >= 0 group by all),
facts as (select cls, count(*) as rows, count(distinct label) filter (label >= 0) discovered, count(*) filter (label < 0) noise from e group by cls),
{_centers("c0", "(select * from e where label >= 0)", "label")},
lost as (select e.vec_id, arg_min(c0.label, struct_pack(d := round({_L2.format(a="e.v", b="c0.c")}, 6), l := c0.label)) label from e join c0 using (cls) where e.label < 0 group by e.vec_id),
placed as (select e.vec_id, e.cls, coalesce(lost.label, e.label) label, v from e join facts using (cls) left join lost using (vec_id) where discovered >= 2),
{_centers("c1", "placed", "label")},
p as (select a.cls, a.label x, b.label y, round({_L2.format(a="a.c", b="b.c")}, 6) d from c1 a join c1 b using (cls) join facts using (cls) where discovered > {_GIVEN_IPC}),
t0 as (select cls, min(x) l from p group by cls), t1 as (select p.cls, {_FAR.format(x="x", d="d")} l from p join t0 on t0.cls = p.cls and y = t0.l where x <> t0.l group by p.cls),
gap as (select p.cls, x, min(d) d from p join (select * from t0 union all select * from t1) t on t.cls = p.cls and y = t.l group by all),
t2 as (select gap.cls, {_FAR.format(x="x", d="d")} l from gap where (gap.cls, x) not in (select cls, l from t0 union all select cls, l from t1) group by gap.cls),
chosen as (select cls, l as label, 0 turn from t0 union all select cls, l, 1 from t1 union all select cls, l, 2 from t2),
moved as (select p.cls, x as label, arg_min(y, struct_pack(d := d, l := y)) goal from p join chosen k on k.cls = p.cls and k.label = y where (p.cls, x) not in (select cls, label from chosen) group by all),
turns as (select cls, label, turn from chosen union all select m.cls, m.label, k.turn from moved m join chosen k on k.cls = m.cls and k.label = m.goal
  union all select cls, label, row_number() over (partition by cls order by label) - 1 from c1 join facts using (cls) where discovered <= {_GIVEN_IPC}),
sizes as (select cls, turn, count(*) n from placed join turns using (cls, label) group by all),
q as (select *, count(*) over w k, row_number() over (partition by cls order by turn) r, n / sum(n) over w * ({_GIVEN_IPC} - count(*) over w) x from sizes window w as (partition by cls)),
z as (select *, {_GIVEN_IPC} - k - sum(floor(x)) over (partition by cls) rest, row_number() over (partition by cls order by round(x - floor(x), 9) desc, turn) nth from q),
quotas as (select cls, turn, n, cast(case when k >= {_GIVEN_IPC} then cast(r <= {_GIVEN_IPC} as int) else 1 + floor(x) + case when nth <= rest then 1 else 0 end end as int) quota from z),
shares as (select cls, string_agg(n, ',' order by turn) sizes, string_agg(quota, ',' order by turn) allocation, count(*) filter (quota > 1) subclustered from quotas group by cls),
found as (select cls, string_agg(n, ',' order by label) discovered_sizes from seen group by cls),
diagnostics as (select facts.cls, case when discovered < 2 then '{M.FALLBACK}' when discovered > {_GIVEN_IPC} then '{M.CHOSEN}' else '{M.SHARED}' end branch, rows, discovered, noise,
  discovered_sizes, sizes, allocation, coalesce(subclustered, 0) subclustered, case when discovered < 2 then cast(least({_GIVEN_IPC}, rows) as int) end kmeans_k
  from facts left join found using (cls) left join shares using (cls))"""
_add("branch_diagnostics", lambda s, d: _lists(_given(s, d).diagnostics), f"{_GIVEN_SQL} select * from diagnostics")
_add("branch_rollup", lambda s, d: M.branch_rollup(_given(s, d).diagnostics), f"{_GIVEN_SQL} select branch, count(*) as groups, cast(sum(subclustered) as bigint) subclustered from diagnostics group by branch")
# the parts of split modes come from K-Means, so SQL follows how many labels a group has and that its rows keep their modes' sizes
_add("discover_modes_given", lambda s, d: _given(s, d).labels)
_AXES = 8


def _variances(s, d):
    """Variance along each axis of a group, for which another engine needs no decomposition: their sum over all axes is the whole variance."""
    r = K.group_pca(_rows(s, d), "cls", "vec_id", 64)
    return r.select("cls", F.posexplode("embedding").alias("axis", "x")).groupBy("cls", "axis").agg(F.var_samp("x").alias("v")).groupBy("cls").agg(F.round(F.sum("v"), 4).alias("variance"), F.count("*").alias("axes"))


_add("group_pca", lambda s, d: K.group_pca(_rows(s, d), "cls", "vec_id", _AXES))
_add(
    "group_pca_variance",
    _variances,
    """with e as (select label % 3 cls, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), n as (select cls, count(*) n, max(len(v)) dim from e group by cls),
    u as (select cls, i.i, var_samp(v[i.i]) s from e, (select unnest(range(1, (select max(len(embedding)) from embeddings) + 1)) i) i group by all)
    select cls, round(sum(s), 4) variance, cast(least(max(n), max(dim), 64) as bigint) axes from u join n using (cls) group by cls""",
)
