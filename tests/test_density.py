"""Density clustering with balls and bands against plain numpy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import density as D


def clustered(n, centers, dim, seed, spread=0.25, noise=0.03):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centers, dim)) * 6
    v = x[rng.integers(0, centers, n)] + rng.normal(size=(n, dim)) * spread
    far = rng.random(n) < noise
    v[far] = rng.normal(size=(int(far.sum()), dim)) * 6
    return np.round(v, 4)


def apart(v):
    return np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)


def plain_core(v, need):
    d = np.sort(apart(v) + np.diag([np.inf] * len(v)), 1)
    return d[:, min(need, len(v) - 1) - 1] if len(v) > 1 else np.zeros(1)


def plain_tree(v, core):
    return D.prim(v, core)


def plain_condensed(n, edges, least):
    """Clusters from the whole dendrogram, top down (the plain reading of the paper): a frozenset a cluster."""
    kids, size, node, height = {}, {i: 1 for i in range(n)}, list(range(n)), {}
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        x, y = node[int(a)], node[int(b)]
        me = n + len(kids)
        kids[me], height[me], size[me] = (x, y), max(w, 1e-12), size[x] + size[y]
        node = [me if k in (x, y) else k for k in node]

    def points(v):
        return [v] if v < n else points(kids[v][0]) + points(kids[v][1])

    def cluster(v, birth, root):
        """(mass of the best choice in and below, the chosen sets)."""
        members, mass, below = set(points(v)), 0.0, (0.0, [])
        while v >= n:
            lam = 1 / height[v]
            big = [c for c in kids[v] if size[c] >= least]
            mass += sum(size[c] for c in kids[v] if size[c] < least) * (lam - birth)
            if len(big) == 2:
                mass += size[v] * (lam - birth)
                parts = [cluster(c, lam, False) for c in big]
                below = (sum(p[0] for p in parts), [s for p in parts for s in p[1]])
            if len(big) != 1:
                break
            v = big[0]
        return (mass, [frozenset(members)]) if not root and mass >= below[0] else below

    return set(cluster(n + len(kids) - 1, 0.0, True)[1]) if kids else set()


def sets_of(label):
    return {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label[label >= 0].tolist())}


@pytest.mark.parametrize("seed", range(12))
def test_condensing_from_below_gives_the_dendrogram_s_clusters(seed):
    v = clustered(140, 5, 2, seed, spread=0.8, noise=0.2)
    edges = D.prim(v, plain_core(v, 2))
    for least in (3, 5, 15):
        label = D.condensed_labels(len(v), edges[:, 0].astype(int), edges[:, 1].astype(int), edges[:, 2], least)
        assert sets_of(label) == plain_condensed(len(v), edges.tolist(), least)  # clusters hold the points that leave them, not only those that stay
        first = [int(np.argmax(label == k)) for k in range(label.max() + 1)]
        assert first == sorted(first)


def table(spark, groups):
    rows = [(1000 * g + i, g, x.tolist()) for g, v in enumerate(groups) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, cls int, embedding array<double>")


def test_cores_and_trees_are_exact_and_few_rows_meet(spark):
    small, large = clustered(300, 6, 6, 1), clustered(900, 18, 6, 2)
    met = []
    for v in (small, large):
        v = np.unique(v, axis=0)
        df = table(spark, [v]).withColumnRenamed("vec_id", "a").withColumnRenamed("embedding", "v").withColumn("n", F.lit(1).cast("long"))
        cores = D.core_distances(df, "cls", 2, block=24)
        got = {r.a: r.core for r in cores.collect()}
        want = plain_core(v, 2)
        assert [got[i] for i in range(len(v))] == want.tolist()
        edges, pairs = D._tree(cores, "cls")
        tree = D.spanning_forest(edges, "cls").collect()
        assert len(tree) == len(v) - 1
        assert sorted(r.w for r in tree) == sorted(D.prim(v, want)[:, 2].tolist())
        size = {r.cell: r["count"] for r in cores.groupBy("cell").count().collect()}
        met.append(sum(size[r.lo] * size[r.hi] for r in pairs.collect()) / len(v) ** 2)
    assert met[0] < 0.35 and met[1] < 0.6 * met[0], met  # pairs of rows that meet; 0.5 would be all


def test_equal_rows_count(spark):
    rows = [[0.0, 0.0]] * 5 + [[1.0, 0.0]] * 2 + [[3.0, 0.0], [7.0, 0.0]]
    df = table(spark, [np.array(rows)]).groupBy("cls", F.col("embedding").alias("v")).agg(F.min("vec_id").alias("a"), F.count("*").alias("n"))
    got = {tuple(r.v): r.core for r in D.core_distances(df, "cls", 2, block=2).collect()}
    assert got == {(0.0, 0.0): 0.0, (1.0, 0.0): 1.0, (3.0, 0.0): 2.0, (7.0, 0.0): 6.0}
    one = D.core_distances(table(spark, [np.zeros((1, 2))]).selectExpr("vec_id a", "cls", "embedding v", "1L n"), "cls", 2).first()
    assert one.core == 0.0


@pytest.mark.parametrize("band", [40, 1 << 20])
def test_bands_and_blocks_change_no_label(spark, band):
    groups = [clustered(200, 4, 3, 5, spread=0.5, noise=0.1), np.repeat(clustered(60, 3, 3, 6), 2, axis=0), clustered(25, 1, 2, 7, spread=3), np.zeros((1, 2))]
    df = table(spark, groups)
    rows = df.unionByName(spark.createDataFrame([(90000, 0, None), (90001, None, [1.0] * 3)], df.schema)).repartition(5)
    got = {r.vec_id: r.label for r in D.density_modes(rows, "cls", "vec_id", 4, min_cluster_size=6, block=30, band=band).collect()}
    assert set(got) == {1000 * g + i for g, v in enumerate(groups) for i in range(len(v))}
    for g, v in enumerate(groups):
        label = np.array([got[1000 * g + i] for i in range(len(v))])
        if len(v) == 1:
            assert label.tolist() == [-1]
            continue
        edges = D.prim(v, plain_core(v, 2))
        least = min(6, max(len(v) // 4, 5))
        assert sets_of(label) == plain_condensed(len(v), edges.tolist(), least)
        first = [int(np.argmax(label == k)) for k in range(label.max() + 1)]
        assert first == sorted(first)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, cls int, embedding array<double>")
    assert D.density_modes(df, "cls", "vec_id", 3).count() == 0


def test_registered_query_against_plain(spark):
    from curatrix.plans import condensation as C

    sf = "/root/testdata/sf0.001"
    got = {r.vec_id: r.label for r in C.QUERIES["density_modes"](spark, sf).collect()}
    rows = [(r.vec_id, r.cls, np.array(r.embedding, float)) for r in C._rows(spark, sf).orderBy("vec_id").collect()]
    assert set(got) == {r[0] for r in rows}
    for cls in {r[1] for r in rows}:
        v = np.stack([x for _, c, x in rows if c == cls])
        label = np.array([got[i] for i, c, _ in rows if c == cls])
        edges = sorted(((min(a, b), max(a, b), w) for a, b, w in D.prim(v, plain_core(v, 2)).tolist()), key=lambda e: (e[2], e[0], e[1]))  # equal heights in order of ends
        assert sets_of(label) == plain_condensed(len(v), edges, min(15, max(len(v) // C.IPC, 5)))


def test_rows_without_clusters_leave_few_edges_in_order_of_ends(spark):
    """All balls meet there: each pair of them gave a whole tree of its rows, so edges grew with the square of the rows."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(600, 12))
    v[300:] = np.round(v[300:])  # equal heights
    v = np.unique(v, axis=0)
    df = table(spark, [v]).withColumnRenamed("vec_id", "a").withColumnRenamed("embedding", "v").withColumn("n", F.lit(1).cast("long"))
    core = plain_core(v, 2)
    i, j = np.triu_indices(len(v), 1)
    w = np.maximum(np.maximum(apart(v)[i, j], core[i]), core[j])
    head, want = list(range(len(v))), []
    for k in np.lexsort((j, i, w)):
        if head[i[k]] != head[j[k]]:
            gone = head[j[k]]
            head = [head[i[k]] if h == gone else h for h in head]
            want.append((int(i[k]), int(j[k]), float(w[k])))
    for band in (1000, 100):
        edges = D._tree(D.core_distances(df, "cls", 2, block=48), "cls", band)[0]
        assert sorted(tuple(r) for r in D.spanning_forest(edges, "cls").collect()) == sorted(want)
        assert band < len(v) or edges.count() < 6 * len(v)


def test_forest_and_heights_against_plain():
    rng = np.random.default_rng(4)
    for n in (1, 2, 40):
        a, b = rng.integers(0, n, 200), rng.integers(0, n, 200)
        a, b, w = np.minimum(a, b), np.maximum(a, b), rng.integers(0, 6, 200).astype(float)
        head, want = list(range(n)), []
        for k in np.lexsort((b, a, w)):
            if head[a[k]] != head[b[k]]:
                gone = head[b[k]]
                head = [head[a[k]] if h == gone else h for h in head]
                want.append((a[k], b[k], w[k]))
        e = D.forest(n, a, b, w)
        assert [(a[k], b[k], w[k]) for k in e] == want
        h, hub = D.heights(n, a[e], b[e], w[e], 0), {0: 0.0}
        for _ in range(n):
            for k in e:
                for x, y in ((a[k], b[k]), (b[k], a[k])):
                    if x in hub and y not in hub:
                        hub[y] = max(hub[x], w[k])
        assert h.tolist() == [hub.get(x, np.inf) for x in range(n)]
