"""Mode discovery after density labels, farthest points, axes and K-Means against plain numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import cluster as K
from curatrix.operators import modes as M
from curatrix.operators import vectors as V


def plain_farthest(points, n):
    at = [0]
    while len(at) < min(n, len(points)):
        gap = np.round(np.linalg.norm(points[:, None] - points[at], axis=2), 6).min(1)
        gap[at] = -1
        at.append(int(gap.argmax()))
    return at


def centers_of(spark, groups, count, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(g, 3 * k + 1, rng.normal(size=dim).tolist()) for g in range(groups) for k in range(count)]
    rows += [(groups, 5, [1.0] * dim), (groups, 2, [1.0] * dim), (groups, 9, [2.0] * dim)]  # ties
    return spark.createDataFrame(rows, "cls int, label long, centroid array<double>"), rows


def test_fifty_of_two_hundred(spark):
    df, rows = centers_of(spark, 3, 200)
    start = time.time()
    got = sorted(map(tuple, V.farthest_point(df, "cls", "label", 50).collect()))
    assert time.time() - start < 30
    for g in range(3):
        mine = sorted(r for r in rows if r[0] == g)
        at = plain_farthest(np.array([r[2] for r in mine]), 50)
        assert [x[1:] for x in got if x[0] == g] == sorted((mine[k][1], turn) for turn, k in enumerate(at))
    assert sorted(x[1:] for x in got if x[0] == 3) == [(2, 0), (5, 2), (9, 1)]


def test_large_groups_go_by_rounds(spark):
    df, _ = centers_of(spark, 2, 30)
    one = sorted(map(tuple, V.farthest_point(df, "cls", "label", 6).collect()))
    rounds = V.farthest_point(df, "cls", "label", 6, block=10)
    assert sorted(map(tuple, rounds.collect())) == one
    lines = lambda n: len(V.farthest_point(df, "cls", "label", n, block=10)._jdf.queryExecution().executedPlan().toString().splitlines())
    assert lines(3) == lines(9)
    assert V.farthest_point(df.limit(0), "cls", "label", 3).count() == 0


def plain_modes(x, label, ipc):
    """(turn of each row, discovered sizes, sizes, allocation) of one group of two modes or more."""
    modes = sorted(set(label[label >= 0]))
    center = lambda m, lab: x[lab == m].mean(0)
    lab, c = label.copy(), np.stack([center(m, label) for m in modes])
    for i in np.flatnonzero(label < 0):
        lab[i] = modes[int(np.round(np.linalg.norm(c - x[i], axis=1), 6).argmin())]
    order = modes
    c = np.stack([center(m, lab) for m in modes])
    goal = {m: m for m in modes}
    if len(modes) > ipc:
        order = [modes[k] for k in plain_farthest(c, ipc)]
        kept = sorted(order)
        for m in set(modes) - set(order):
            d = [round(float(np.linalg.norm(c[modes.index(k)] - c[modes.index(m)])), 6) for k in kept]
            goal[m] = kept[int(np.argmin(d))]
    turn = np.array([order.index(goal[m]) for m in lab])
    sizes = np.bincount(turn).tolist()
    if len(modes) >= ipc:
        share = [1] * ipc
    else:
        exact = [s / sum(sizes) * (ipc - len(sizes)) for s in sizes]
        share = [1 + int(e) for e in exact]
        for k in sorted(range(len(sizes)), key=lambda k: (-round(exact[k] - int(exact[k]), 9), k))[: ipc - sum(share)]:
            share[k] += 1
    return turn, [int((label == m).sum()) for m in modes], sizes, share


@pytest.mark.parametrize("ipc", [1, 2, 4, 9])
def test_modes_against_plain(spark, ipc):
    rng = np.random.default_rng(ipc)
    rows = []
    for g, modes in enumerate([0, 1, 2, 3, 6]):
        for i in range(70):
            mode = int(rng.integers(-1, modes)) if modes else -1
            rows.append((1000 * g + i, g, 4 * mode + 3 if mode >= 0 else -1, (rng.normal(size=5) + 3 * mode).tolist()))
    rows += [(9000, 7, 0, [1.0] * 5), (9001, 7, -1, None), (9002, None, 1, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, cls int, label int, embedding array<double>")
    got = M.assign_modes(df, df.select("vec_id", "cls", "label"), "cls", "vec_id", ipc)
    labels, facts = {r.vec_id: r.label for r in got.labels.collect()}, {r.cls: r for r in got.diagnostics.collect()}
    assert set(labels) == {r[0] for r in rows} - {9001, 9002} and set(facts) == {0, 1, 2, 3, 4, 7}
    for g in range(5):
        mine = [r for r in rows if r[1] == g]
        label, x, mode = np.array([labels[r[0]] for r in mine]), np.array([r[3] for r in mine]), np.array([r[2] for r in mine])
        assert sorted(set(label)) == list(range(label.max() + 1)) and label.max() < ipc
        f = facts[g]
        assert (f["rows"], f.noise, f.discovered) == (70, int((mode < 0).sum()), len(set(mode[mode >= 0])))
        if f.discovered < 2:
            assert (f.branch, f.kmeans_k, f.subclustered, f.allocation) == (M.FALLBACK, ipc, 0, None)
            continue
        turn, found, sizes, share = plain_modes(x, mode, ipc)
        assert f.branch == (M.CHOSEN if f.discovered > ipc else M.SHARED)
        assert (f.discovered_sizes, f.sizes, f.allocation) == (found, sizes, share)
        assert f.subclustered == sum(s > 1 for s in share)
        at = 0
        for t, s in enumerate(share):  # each mode's labels follow those of the modes before it
            own = sorted(set(label[turn == t]))
            assert own == list(range(at, at + len(own))) and len(own) <= s and (s > 1 or len(own) == 1)
            at += len(own)
    assert facts[7].branch == M.FALLBACK and facts[7].kmeans_k == 1
    rolled = {r.branch: (r.groups, r.subclustered) for r in M.branch_rollup(got.diagnostics).collect()}
    assert sum(r[0] for r in rolled.values()) == 6 and sum(r[1] for r in rolled.values()) == sum(f.subclustered for f in facts.values())


def test_no_rows_no_modes(spark):
    df = spark.createDataFrame([], "vec_id long, cls int, label int, embedding array<double>")
    got = M.assign_modes(df, df.select("vec_id", "cls", "label"), "cls", "vec_id", 3)
    assert got.labels.count() == 0 and got.diagnostics.count() == 0


def test_discovered_modes_stay_within_ipc(spark):
    rng = np.random.default_rng(0)
    rows = [(100 * c + i, 0, (rng.normal(0, 0.2, 8) + 9 * np.eye(8)[c]).tolist()) for c in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, cls int, embedding array<double>")
    for ipc, branch in ((3, M.CHOSEN), (7, M.SHARED)):
        got = M.discover_modes(df, "cls", "vec_id", ipc, pca_dim=4)
        label = {r.vec_id: r.label for r in got.labels.collect()}
        assert len(label) == 150 and set(label.values()) == set(range(ipc))
        fact = got.diagnostics.first()
        assert (fact.branch, fact.discovered, sum(fact.sizes), sum(fact.allocation)) == (branch, 5, 150, ipc)
        for c in range(5):  # blobs are never mixed with a part of another
            assert ipc == 3 or not {label[100 * c + i] for i in range(30)} & {label[i] for i in label if i // 100 != c}


@pytest.mark.parametrize("dim,keep,n", [(5, 2, 90), (768, 20, 60)])
def test_axes_by_blocks(spark, dim, keep, n):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim)) * np.linspace(3, 0.1, dim) + 1e4  # a mean far above the spread
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(n, 1, [0.0] * dim), (n + 1, 1, None)], "vec_id int, cls int, embedding array<double>")
    got = {r.vec_id: r.embedding for r in K.group_pca(df, "cls", "vec_id", keep, block=16, fan=2).collect()}
    assert set(got) == set(range(n + 1)) and len(got[n]) == 1
    y = np.array([got[i] for i in range(n)])
    s = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(y.var(0) * n, s.S[:keep] ** 2, rtol=1e-6)
    off = np.corrcoef(y.T) - np.eye(keep)
    assert np.abs(off).max() < 1e-6
    whole = s.U[:, :keep] * s.S[:keep]
    assert np.allclose(np.abs(y), np.abs(whole), atol=1e-5)


@pytest.mark.parametrize("k", [1, 3, 12])
def test_bounds_change_no_label(k):
    rng = np.random.default_rng(k)
    v = np.round(rng.normal(size=(400, 3)) + 4 * rng.integers(0, 3, (400, 1)), 2)
    first = rng.permutation(400)[:k]
    label, cost = K._solve(v, first, None, 1e-4)
    c, names = v[first].copy(), np.arange(k)
    while True:
        at = np.round(np.linalg.norm(v[:, None] - c, axis=2), 6).argmin(1)
        used = np.unique(at)
        new = np.stack([v[at == j].mean(0) for j in used])
        moved = ((new - c[used]) ** 2).sum()
        c, names = new, names[used]
        if moved <= 1e-4 * v.var(0).mean():
            break
    d = np.round(np.linalg.norm(v[:, None] - c, axis=2), 6)
    assert (names[d.argmin(1)] == label).all() and abs((d.min(1) ** 2).sum() - cost) < 1e-5


def test_a_group_that_never_settles_is_told():
    with pytest.raises(RuntimeError):
        monkey = K.MOST
        K.MOST = 1
        try:
            K._solve(np.random.default_rng(0).normal(size=(200, 2)), np.arange(20), None, 0.0)
        finally:
            K.MOST = monkey


def test_registered_kmeans_against_lloyd(spark):
    from curatrix.plans import condensation as C

    sf = "/root/testdata/sf0.001"
    rows = C._rows(spark, sf)
    got = {r.vec_id: r.label for r in C.QUERIES["group_kmeans"](spark, sf).collect()}
    v = {r.vec_id: (r.cls, np.array(r.embedding, float)) for r in rows.collect()}
    seeds = K.kmeans_starts(rows.withColumn("k", F.lit(C.IPC)), "cls", "vec_id", "k", 10).collect()
    assert set(got) == set(v)
    for cls in {c for c, _ in v.values()}:
        ids = sorted(i for i in v if v[i][0] == cls)
        x, runs = np.stack([v[i][1] for i in ids]), []
        for start in range(10):
            c = np.stack([v[r.vec_id][1] for r in sorted(seeds, key=lambda r: r.label) if (r.cls, r.start) == (cls, start)])
            names = np.arange(len(c))
            while True:
                at = np.round(np.linalg.norm(x[:, None] - c, axis=2), 6).argmin(1)
                used = np.unique(at)
                new = np.stack([x[at == j].mean(0) for j in used])
                moved = ((new - c[used]) ** 2).sum()
                c, names = new, names[used]
                if moved <= 1e-4 * x.var(0).mean():
                    break
            d = np.round(np.linalg.norm(x[:, None] - c, axis=2), 6)
            runs.append((round(float((d.min(1) ** 2).sum()), 6), names[d.argmin(1)].tolist()))
        assert [got[i] for i in ids] == min(runs, key=lambda r: r[0])[1]


def test_diagnostics_run_no_kmeans(spark, monkeypatch):
    """Labels are worked out when first asked for, once."""
    from curatrix.operators import modes

    df = spark.range(60).selectExpr("id", "cast(0 as int) g", "array(double(id % 3), double(id)) embedding")
    found = df.selectExpr("id", "g", "id % 3 label")
    asked, split = [], modes.subcluster
    monkeypatch.setattr(modes, "subcluster", lambda *a: asked.append(a) or split(*a))
    m = modes.assign_modes(df, found, "g", "id", 4)
    assert m.diagnostics.count() == 1 and not asked
    assert m.labels.count() == 60 and len(asked) == 1 and m.labels is m.labels


def test_rounds_of_kmeans_merge_their_joins(spark, monkeypatch):
    """A round's joins are merged: each broadcast would take the driver a page of memory, round after round."""
    from curatrix.operators import cluster

    plans, cut = [], cluster._cut
    monkeypatch.setattr(cluster, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = spark.range(90).selectExpr("id", "cast(0 as int) g", "array(double(id % 3) * 100 + id / 90, double(id)) embedding", "3 k")
    assert cluster.group_kmeans(df, "g", "id", "k", block=30, starts=2).count() == 90
    rounds = [p for p in plans if "nanvl" in p]
    assert rounds and all(p.count("SortMergeJoin") >= 2 for p in rounds)


@pytest.mark.parametrize("part", ["labels", "diagnostics"])
def test_no_table_grows_with_pairs_of_rows(spark, monkeypatch, part):
    """Vectors without clusters. The code before the change passes this too at this size (diagnostics): distinct edges are few here."""
    from curatrix.operators import density, forest

    sizes, real = [], density.written

    def noted(df, label):
        out = real(df, label)
        sizes.append((out.count(), label))
        return out

    monkeypatch.setattr(density, "written", noted)
    monkeypatch.setattr(forest, "written", noted)
    v = np.random.default_rng(8).normal(size=(500, 20))
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, cls int, embedding array<double>")
    found = M.discover_modes(df, "cls", "vec_id", 3, pca_dim=12, block=40)
    assert getattr(found, part).count() == (500 if part == "labels" else 1)
    assert max(n for n, label in sizes if label not in ("hops", "pairs")) < 8 * 500, sizes  # hops and pairs are of balls, not of rows
