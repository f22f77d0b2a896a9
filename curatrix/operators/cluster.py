"""Per-group clustering as Spark jobs: K-Means over all groups at once, PCA by blocks; density modes are in their own module."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.density import condensed_labels, density_modes, tree_edges
from curatrix.operators.forest import spanning_forest
from curatrix.operators.vectors import centroids, distance, medoids
from curatrix.session import large, written


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: plans stay short over the rounds, and lost executors cost no round."""
    return written(df, "cluster")


def kmeans_starts(df: DataFrame, group: str, idx: str, k: str, starts: int) -> DataFrame:
    """(group, idx, start, label): for each start the group's k rows of lowest hash of (idx, start), ranked in buckets before all at once."""
    ids = df.select(idx, group, k, F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    ids = ids.withColumn("_h", F.xxhash64(idx, "start")).withColumn("_b", F.pmod(F.xxhash64(idx, F.lit(1)), F.lit(64)))
    for within in ([group, "start", "_b"], [group, "start"]):
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy("_h", idx))).filter(F.col("_r") <= F.col(k))
    return ids.select(group, idx, "start", (F.col("_r") - 1).alias("label"))


def _by_block(blocks: DataFrame, sizes: DataFrame, live: DataFrame, group: str, found: str, work) -> DataFrame:
    """work(ids, vectors, labels, centers) -> columns of `found`, for each block of rows and start of its group. A task holds one
    block and its group's centers; blocks (group, _id, _block, _v) are placed by (group, _block) already, sizes (_g, _n) counts a group's."""
    seats = live.join(large(sizes), F.col(group) == F.col("_g")).select("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), "start", "centers")
    kind = dict(blocks.dtypes)[group]

    def run(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            v = np.stack(rows["_v"].to_numpy())
            for start, centers in zip(starts["start"], starts["centers"], strict=True):
                made = work(rows["_id"].to_numpy(), v, [c["label"] for c in centers], np.array([c["centroid"] for c in centers], float))
                out.append(pd.DataFrame({group: rows[group].iloc[0], "start": start, **made}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in names}, dtype=object)

    names = [f"{group} {kind}", "start int", *found.split(", ")]
    return blocks.groupBy(group, "_block").cogroup(seats.groupBy("_g", "_b")).applyInPandas(run, ", ".join(names))


def _nearest_of(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of each row's nearest center, distances rounded, the first of equals."""
    d = np.stack([np.round(np.sqrt(((v - c) ** 2).sum(1)), 6) for c in centers])
    return d.min(0), d.argmin(0)


def _packed(means: DataFrame, group: str) -> DataFrame:
    """means (group, start, label, _i, _m), one row a component -> (group, start, centers); one shuffle for both levels."""
    whole = means.repartition(group, "start").groupBy(group, "start", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))
    return whole.groupBy(group, "start").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("centers"))


#: Rounds within which K-Means has to settle.
MOST = 300


def _solve(v: np.ndarray, first: np.ndarray, rounds: int | None, tolerance: float) -> tuple[np.ndarray, float]:
    """(label of each row, rounded cost) of Lloyd's rounds from the rows `first`, by the law of group_kmeans. Hamerly's bounds (2010) skip rows: `own`
    bounds the distance to a row's center from above, `other` that to any other center from below; a row is measured again only if they meet."""
    c, slack = v[first].copy(), 1e-5  # distances are compared after rounding, so bounds that are nearly equal count as equal
    names = np.arange(len(c))
    still = tolerance * v.var(0).mean()

    def measure(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.stack([np.round(np.sqrt(((v[rows] - x) ** 2).sum(1)), 6) for x in c])
        at = d.argmin(0)
        near = d[at, np.arange(len(rows))]
        d[at, np.arange(len(rows))] = np.inf
        return at, near, d.min(0)

    every = np.arange(len(v))
    at, own, other = measure(every)
    for _ in range(rounds or MOST):
        used, at = np.unique(at, return_inverse=True)
        count = np.bincount(at, minlength=len(used))
        total = np.zeros((len(used), v.shape[1]))
        np.add.at(total, at, v)
        new = total / count[:, None]
        moved = np.sqrt(((new - c[used]) ** 2).sum(1))
        c, names = new, names[used]
        own, other = own + moved[at], other - moved.max()
        meet = np.flatnonzero(own + slack >= other) if len(c) > 1 else every[:0]
        if len(meet):
            at[meet], own[meet], other[meet] = measure(meet)
        if not (moved**2).sum() > still:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"K-Means did not settle in {MOST} rounds")
    at, own, _ = measure(every)
    return names[at], round(float((own**2).sum()), 6)


def group_kmeans(df: DataFrame, group: str, idx: str, k: str, vec: str = "embedding", rounds: int | None = None, starts: int = 10, tolerance: float = 1e-4, block: int = 4096) -> DataFrame:
    """(idx, group, label): Lloyd's rounds over every group; each group takes its start of least inertia (the first of equals). k: a column with the
    group's number of clusters. Rows without a vector are left out.

    Starts are a group's k rows of lowest hash of (idx, start), so reruns agree. A start has settled when its centers' squared moves add up to at most
    tolerance times the mean variance of the group's components; one that hasn't after MOST rounds is an error, unless `rounds` asks for that many at
    most. A center that loses all rows vanishes. Groups of up to `block` rows are solved to the end in one Arrow pass; larger ones go through rounds over all of them at once, see _rounds.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(idx, group, F.transform(vec, lambda x: x.cast("double")).alias(vec), F.col(k).alias("_k"))
    sizes = _cut(rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")))
    draws = F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda s: F.xxhash64(idx, s))
    few = rows.join(sizes.filter("_n = 1"), F.col(group) == F.col("_g")).select(idx, group, vec, "_k", draws.alias("_h"))
    kinds = dict(df.dtypes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        v, h, want = np.stack(pdf[vec].to_numpy()), np.stack(pdf["_h"].to_numpy()), int(pdf["_k"].fillna(0).iloc[0])
        runs = [_solve(v, np.argsort(h[:, s], kind="stable")[:want], rounds, tolerance) for s in range(starts)] if want > 0 else []
        label = min(runs, key=lambda r: r[1])[0] if runs else np.zeros(0, int)
        return pd.DataFrame({idx: pdf[idx].to_numpy()[: len(label)], group: pdf[group].iloc[0], "label": label})

    out = few.groupBy(group).applyInPandas(whole, f"{idx} {kinds[idx]}, {group} {kinds[group]}, label int")
    many = sizes.filter("_n > 1")
    if many.isEmpty():
        return out
    return out.unionByName(_rounds(rows.join(many, F.col(group) == F.col("_g"), "left_semi"), many, group, idx, vec, rounds, starts, tolerance))


def _rounds(rows: DataFrame, sizes: DataFrame, group: str, idx: str, vec: str, rounds: int | None, starts: int, tolerance: float) -> DataFrame:
    """group_kmeans for groups of several blocks: every group and start in each round at once. A group is cut into blocks that are placed once; in a
    round a block meets its group's centers and gives one sum a center, so only centers are shuffled, however large a group is."""
    seeds = kmeans_starts(rows, group, idx, "_k", starts)
    rows = rows.drop("_k")
    blocks = rows.join(sizes, F.col(group) == F.col("_g")).select(group, F.col(idx).alias("_id"), F.pmod(F.xxhash64(idx, F.lit(3)), "_n").cast("int").alias("_block"), F.col(vec).alias("_v"))
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "_block").persist()
    spread = rows.select(group, F.posexplode(vec).alias("_i", "_x")).groupBy(group, "_i").agg(F.var_pop("_x").alias("_v")).groupBy(group).agg((F.avg("_v") * tolerance).alias("_still"))
    first = seeds.join(rows, [group, idx]).select(group, "start", "label", F.posexplode(vec).alias("_i", "_m"))
    live, settled = _cut(_packed(first, group).join(spread, group)), []

    def sums(ids, v, labels, centers):
        at = _nearest_of(v, centers)[1]
        used = np.unique(at)
        return {"label": [labels[j] for j in used], "n": [int((at == j).sum()) for j in used], "total": [v[at == j].sum(0) for j in used]}

    def seats(ids, v, labels, centers):
        d, at = _nearest_of(v, centers)
        return {idx: ids, "label": np.array(labels)[at], "d": d}

    for _ in range(rounds or MOST):
        part = _by_block(blocks, sizes, live, group, "label int, n long, total array<double>", sums).select(group, "start", "label", "n", F.posexplode("total").alias("_i", "_x"))
        new = _packed(part.groupBy(group, "start", "label", "_i").agg((F.sum("_x") / F.sum("n")).alias("_m")), group)
        old = live.select(group, "start", "_still", F.map_from_entries("centers").alias("_old"))
        move = F.aggregate("centers", F.lit(0.0), lambda s, c: s + F.pow(distance(c["centroid"], F.col("_old")[c["label"]]), F.lit(2)))
        moved = new.join(large(old), [group, "start"]).withColumn("_go", F.nanvl(move, F.lit(0.0)) > F.col("_still"))  # moves that are no numbers settle too
        moved = _cut(moved.select(group, "start", "centers", "_still", "_go"))
        kinds = {r["_go"] for r in moved.select("_go").distinct().collect()}
        settled += [moved.filter("not _go").drop("_go")] if False in kinds else []
        live = moved.filter("_go").drop("_go")
        if True not in kinds:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"K-Means did not settle in {MOST} rounds")
    for one in settled:
        live = live.unionByName(one)
    near = _cut(_by_block(blocks, sizes, live, group, f"{idx} {dict(rows.dtypes)[idx]}, label int, d double", seats))
    blocks.unpersist()
    cost = near.groupBy(group, "start").agg(F.round(F.sum(F.col("d") * F.col("d")), 6).alias("_cost"))
    best = cost.groupBy(group).agg(F.min_by("start", F.struct("_cost", "start")).alias("start"))
    return near.join(best, [group, "start"]).select(idx, group, "label")


def inertia(df: DataFrame, labels: DataFrame, group: str, idx: str, vec: str = "embedding") -> DataFrame:
    rows = df.join(labels, [idx, group])
    d = rows.join(centroids(rows, [group, "label"], vec), [group, "label"])
    return d.groupBy(group).agg(F.sum(F.pow(distance(F.col(vec), F.col("centroid")), F.lit(2))).alias("inertia"))


def subcluster(df: DataFrame, quotas: DataFrame, group: str, label: str, idx: str, vec: str = "embedding") -> DataFrame:
    """(idx, group, label): rows of modes with a quota over 1 are split into min(quota, members) parts; empty parts vanish. Labels are consecutive in a
    group, by mode and part."""
    rows = df.join(quotas.select(group, label, "quota").filter("quota >= 1"), [group, label]).select(idx, group, label, vec, "quota")
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("_n"))
    split = rows.filter("quota > 1").join(sizes, [group, label]).withColumn("_mode", F.to_json(F.struct(group, label))).withColumn("_want", F.least("quota", "_n").cast("int"))
    parts = group_kmeans(split, "_mode", idx, "_want", vec).select(F.col(idx).alias("_i"), F.col("label").alias("_part"))
    whole = rows.filter("quota = 1").select(idx, group, label, F.lit(0).alias("_part"))
    out = _cut(whole.unionByName(split.join(large(parts), F.col(idx) == F.col("_i")).select(idx, group, label, "_part")))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(label, "_part")) - 1
    number = out.select(group, label, "_part").distinct().withColumn("_to", turn)
    return out.join(number, [group, label, "_part"]).select(idx, group, F.col("_to").alias("label"))


def _moments(v: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sum of centered cross-products)."""
    mean = v.mean(0)
    return len(v), mean, (v - mean).T @ (v - mean)


def _together(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the union of disjoint parts (Chan, Golub, LeVeque 1979): nothing is lost to large means."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def group_pca(df: DataFrame, group: str, idx: str, dim: int, vec: str = "embedding", block: int = 4096, fan: int = 16) -> DataFrame:
    """df's vectors, in double, reduced to min(dim, rows, length) numbers by each group's principal axes; the signs make an axis' largest part positive.

    A group is cut into blocks of about `block` rows; a block gives one row with its mean and its matrix of cross-products, which are joined `fan` at a
    time level by level, so a task holds `fan` matrices whatever a group's size; blocks then meet their group's axes. Rows without a vector are left out.
    """
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(vec).isNotNull()).select(idx, group, F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    sizes = _cut(rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")))
    rows = rows.join(sizes, F.col(group) == F.col("_g")).withColumn("_block", F.pmod(F.xxhash64(idx, F.lit(5)), "_n").cast("int")).drop("_g", "_n")
    made = f"{group} {kinds[group]}, _block int, n long, mean binary, cross binary"

    def packed(pdf: pd.DataFrame, m: tuple[int, np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "_block": [int(pdf["_block"].iloc[0])], "n": [m[0]], "mean": [m[1].tobytes()], "cross": [m[2].tobytes()]})

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(pdf, _moments(np.stack(pdf["_v"].to_numpy())))

    def parts(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        mean = [np.frombuffer(m) for m in pdf["mean"]]
        return _together([(n, m, np.frombuffer(c).reshape(len(m), -1)) for n, m, c in zip(pdf["n"], mean, pdf["cross"], strict=True)])

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, cross = parts(pdf)
        _, v = np.linalg.eigh(cross)
        v = v[:, ::-1][:, : min(dim, len(mean), n)]
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])  # a sign that doesn't depend on the solver
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [mean.tobytes()], "axes": [np.ascontiguousarray(v).tobytes()]})

    level, most = rows.groupBy(group, "_block").applyInPandas(moments, made), sizes.agg(F.max("_n")).first()[0] or 0
    while most > fan:
        level = level.withColumn("_block", F.floor(F.col("_block") / fan).cast("int")).groupBy(group, "_block").applyInPandas(lambda pdf: packed(pdf, parts(pdf)), made)
        most = -(-most // fan)
    found = _cut(level.groupBy(group).applyInPandas(axes, f"{group} {kinds[group]}, mean binary, axes binary"))

    def project(pdf: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (idx, group, vec)})
        mean = np.frombuffer(a["mean"].iloc[0])
        y = (np.stack(pdf["_v"].to_numpy()) - mean) @ np.frombuffer(a["axes"].iloc[0]).reshape(len(mean), -1)
        return pd.DataFrame({idx: pdf[idx], group: pdf[group], vec: list(y)})

    seats = found.join(sizes, F.col(group) == F.col("_g")).select("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), "mean", "axes")
    return rows.groupBy(group, "_block").cogroup(seats.groupBy("_g", "_b")).applyInPandas(project, f"{idx} {kinds[idx]}, {group} {kinds[group]}, {vec} array<double>")


__all__ = ["condensed_labels", "density_modes", "group_kmeans", "group_pca", "inertia", "medoids", "spanning_forest", "subcluster", "tree_edges"]
