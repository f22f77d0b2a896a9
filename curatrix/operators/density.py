"""Density modes (Campello, Moulavi, Sander 2013) of every group at once: core distances, the spanning tree of mutual reachability, clusters from it.

Rows of a group are cut into balls around some of them. What the triangle inequality says about two balls decides whether their rows meet at all: for core
distances a row visits only balls that reach into its present radius; for the tree two balls meet only if an edge between them could be lighter than the
path that already joins them. Where vectors have no clusters all balls meet: then a task takes two stretches of balls at once, multiplies their vectors as
matrices and keeps what can matter alone, the nearest rows and a forest, so what is shuffled grows as rows times stretches and never as pairs. Equal
vectors count as one, with their number. A tree of more than BAND edges is cut into clusters band by band of its heights, from below, so that no task
holds a whole large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.forest import spanning_forest
from curatrix.session import large, written

#: Rows of a task: a ball holds a quarter of them on average, and balls of more than twice as many are parted by a hash. Small balls around rows of
#: every cluster, those with a quarter of a block's rows at least, rule out more than few wide ones.
BLOCK, CENTERS = 1024, 4
#: Balls of neighbouring numbers meet others in one task: a ball's number less this many bits (8 centers, about 2 * BLOCK rows).
NEAR = 28
#: Balls next to each other form stretches of at most about SPAN rows; a task meets two of them. Groups of a few thousand rows have up to SPREAD stretches.
SPAN, SPREAD = 1 << 15, 4
#: Rows a task places into balls; bytes of vectors in a packed row; rows that a ball meets in one product; edges a task collects before it folds them.
PLACED, PACK, MEET, FOLD = 1 << 14, 1 << 17, 1 << 11, 1 << 20
#: Rows whose tree one task builds and cuts into clusters.
BAND = 1 << 18
#: Digits of distances that are compared.
DIGITS = 9


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded distances of each row of x to each row of y."""
    return np.round(np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2)), DIGITS)


def _slices(n: int, width: int) -> Iterator[slice]:
    """Runs of rows whose distances to `width` others fit in about 8 MB."""
    step = max(1, (1 << 20) // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _empty(names) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _squares(x: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Factors (left, right) whose products are squared distances, and how far such a product may be off, for rows about as far from `shift` as these."""
    y = x - shift
    n = (y**2).sum(1)
    one = np.ones(len(y))
    return np.column_stack([y, n, one]), np.column_stack([-2 * y, one, n]), 4e-15 * (y.shape[1] + 8) * float(np.nanmax(n, initial=0.0))


def _below(h: np.ndarray, slack: float) -> np.ndarray:
    """Squares up to which a rounded distance may be as small as h."""
    return (h + 2 * 10.0**-DIGITS) ** 2 + slack


def _between(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded distances of rows i to rows j."""
    parts = [np.round(np.sqrt(((v[i[s]] - v[j[s]]) ** 2).sum(1)), DIGITS) for s in _slices(len(i), v.shape[1])]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first_of_each(key: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, then by the others; place of each among those of its key)."""
    order = np.lexsort((*by[::-1], key))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])[: len(k)]
    start = np.flatnonzero(new)
    return order, np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))


def forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges, in order of (w, a, b), of the minimum spanning forest over points 0 .. n - 1 that takes edges in that order; a < b. Boruvka's rounds."""
    order = np.lexsort((b, a, w))
    x, y, live = a[order], b[order], np.arange(len(order))
    root, kept = np.arange(n), []
    while True:
        rx, ry = root[x[live]], root[y[live]]
        apart = rx != ry
        live, rx, ry = live[apart], rx[apart], ry[apart]
        if not len(live):
            break
        one, two = np.full(n, len(order)), np.full(n, len(order))
        one[rx[::-1]], two[ry[::-1]] = live[::-1], live[::-1]  # the last value given stays: the lightest
        best = np.minimum(one, two)
        has = np.flatnonzero(best < len(order))
        pick = best[has]
        kept.append(np.unique(pick))
        to = np.arange(n)
        to[has] = root[x[pick]] + root[y[pick]] - has
        twice = to[to] == np.arange(n)  # two that chose each other: the smaller stays
        to[twice & (np.arange(n) < to)] = np.flatnonzero(twice & (np.arange(n) < to))
        while len(np.flatnonzero(to[to] != to)):
            to = to[to]
        root = to[root]
    return order[np.sort(np.concatenate(kept))] if kept else order[:0]


def heights(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, hub: int) -> np.ndarray:
    """The heaviest edge of a tree on the way from each point to the hub; infinite without a way."""
    ends, others, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(ends, kind="stable")
    others, edge, stop = others[order], edge[order], np.cumsum(np.bincount(ends, minlength=n))
    h, seen, at = np.full(n, np.inf), np.zeros(n, bool), np.array([hub])
    h[hub], seen[hub] = 0.0, True
    while len(at):
        many = stop[at] - np.where(at > 0, stop[at - 1], 0)
        e = np.arange(many.sum()) + np.repeat(stop[at] - np.cumsum(many), many)
        up, e = np.repeat(h[at], many)[fresh := ~seen[others[e]]], e[fresh]
        at = others[e]
        h[at], seen[at] = np.maximum(up, edge[e]), True
    return h


def heart(n: int, a: np.ndarray, b: np.ndarray) -> int:
    """The point one comes to from the top of a tree, given in order of height, by always going to the part of more points: most points join it low."""
    head, size = list(range(n)), [1] * n
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while head[x] != x:
            head[x] = x = head[head[x]]
        while head[y] != y:
            head[y] = y = head[head[y]]
        if size[x] < size[y]:
            x, y = y, x
        head[y] = x
        size[x] += size[y]
    return max(range(n), key=lambda i: size[i] if head[i] == i else 0)


def _tasks(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys of tasks whose work is much for their bytes, so Spark doesn't put several into one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _packs(pdf: pd.DataFrame, v: np.ndarray, **columns) -> pd.DataFrame:
    """Rows of a ball as a few packed ones; numbers as bytes."""
    step = max(1, PACK // max(1, v.shape[1] * 8))
    cuts = [slice(i, i + step) for i in range(0, len(v), step)]
    made = {"part": range(len(cuts)), "a": [pdf["a"].to_numpy()[c] for c in cuts], "v": [v[c].tobytes() for c in cuts]}
    return pd.DataFrame(made | {k: [np.ascontiguousarray(x[c]).tobytes() for c in cuts] for k, x in columns.items()})


class _Stretch:
    """The rows of packed balls, one ball after the other."""

    def __init__(self, packs: pd.DataFrame, **columns):
        packs = packs.sort_values(["cell", "part"])
        self.a = np.concatenate(packs["a"].to_numpy())
        joined = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in packs[c]])
        self.v = joined("v", float).reshape(len(self.a), -1)
        for c, kind in columns.items():
            setattr(self, c, joined(c, kind))
        n = packs["a"].map(len).groupby(packs["cell"], sort=True).sum()
        stop = np.cumsum(n.to_numpy())
        self.at = {int(c): slice(int(e - k), int(e)) for c, k, e in zip(n.index, n, stop, strict=True)}
        self.left, self.right, self.slack = _squares(self.v, self.v[0])

    def ball(self, cell: int) -> tuple[np.ndarray, float]:
        """A ball around its rows' mean."""
        v = self.v[self.at[cell]]
        c = v.mean(0)
        return c, float(np.sqrt(((v - c) ** 2).sum(1)).max())

    def runs(self, cells: list[int]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Balls in turn, as many at once as make MEET rows: (their places in `cells`, their rows)."""
        some, rows = [], 0
        for k, c in enumerate(cells):
            some, rows = [*some, k], rows + self.at[c].stop - self.at[c].start
            if rows >= MEET or k == len(cells) - 1:
                yield some, np.concatenate([np.arange(self.at[cells[i]].start, self.at[cells[i]].stop) for i in some])
                some, rows = [], 0


def _lowest(rows: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """The rows of lowest hash of each group, as many as counts (_g, _m) says; ranked in buckets before all at once."""
    r = rows.join(counts, F.col(group) == F.col("_g")).withColumn("_h", F.xxhash64("a"))
    for within in ([group, F.pmod(F.xxhash64("a", F.lit(1)), F.lit(64))], [group]):
        r = r.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy("_h", "a"))).filter(F.col("_r") <= F.col("_m"))
    return r.select(group, (F.col("_r") - 1).alias("_j"), F.col("v").alias("_c"))


def into_balls(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """rows (a, group, v and whatever else) plus cell (a number in the group), center, far (distance to it). Each row belongs to the nearest of CENTERS * rows /
    block centers, which are rows themselves; large balls are parted, all parts keep their center."""
    kinds = dict(rows.dtypes)
    sizes = written(rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(CENTERS * F.count("*") / block).cast("int").alias("_m"), F.ceil(F.count("*") / PLACED).cast("int").alias("_blocks")), "sizes")
    packed = _lowest(rows.select("a", group, "v"), group, sizes.select("_g", "_m")).groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_j", "_c"))).alias("_centers"))
    seats = packed.join(sizes, "_g").select("_g", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), "_centers")
    out = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", _j int, far double"

    def place(mine: pd.DataFrame, seat: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return _empty(_names(out))
        c, v = np.array([x["_c"] for x in seat["_centers"].iloc[0]]), np.stack(mine["v"].to_numpy())
        right = _squares(c, c[0])[1]
        near = np.concatenate([(_squares(v[s], c[0])[0] @ right.T).argmin(1) for s in _slices(len(v), len(c) + v.shape[1])])
        far = np.concatenate([np.round(np.sqrt(((v[s] - c[near[s]]) ** 2).sum(1)), DIGITS) for s in _slices(len(v), v.shape[1])])
        return mine.drop(columns="_block").assign(_j=near, far=far)

    placed = rows.join(sizes, F.col(group) == F.col("_g")).withColumn("_block", F.pmod(F.xxhash64("a", F.lit(3)), "_blocks").cast("int")).drop("_g", "_m", "_blocks")
    placed = written(placed.groupBy(group, "_block").cogroup(seats.groupBy("_g", "_b")).applyInPandas(place, out), "placed")
    # a few far rows would make a ball wide, so they are a ball of their own
    half = placed.groupBy(F.col(group).alias("_g"), F.col("_j").alias("_k")).agg(F.percentile_approx("far", 0.5).alias("_half"))
    same = (F.col(group) == F.col("_g")) & (F.col("_j") == F.col("_k"))
    placed = placed.join(half, same).withColumn("_shell", (F.col("far") > 2 * F.col("_half")).cast("int")).drop("_g", "_k", "_half")
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_j").alias("_k"), F.col("_shell").alias("_s")).agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("_p"))
    part = F.pmod(F.xxhash64("a", F.lit(7)), "_p")
    placed = placed.join(parts, same & (F.col("_shell") == F.col("_s"))).withColumn("cell", ((F.col("_j").cast("long") * 2 + F.col("_shell")) * (1 << 24) + part).cast("long"))
    centers = packed.select("_g", F.inline("_centers")).withColumnRenamed("_j", "_k")
    placed = placed.drop("_g", "_k", "_s", "_p").join(centers, (F.col(group) == F.col("_g")) & (F.col("_j") == F.col("_k")))
    return written(placed.select(*kinds, "cell", F.col("_c").alias("center"), "far"), "balls")


def _by_cells(cells: DataFrame, group: str, out: str, work, stride: int = 256) -> DataFrame:
    """work(own, all) -> frame of `out` for each stride of a group's cells, which meets all cells of its group: one row a ball, never rows."""
    packed = cells.groupBy(F.col(group).alias("_g")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in cells.columns if c != group]))).alias("_all"), F.count("*").alias("_n"))
    seats = packed.select("_g", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / stride).cast("int"))).alias("_s"), "_all")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in pdf["_all"].iloc[0]])
        s = int(pdf["_s"].iloc[0])
        made = work(every.iloc[s * stride : (s + 1) * stride], every)
        made.insert(0, group, pdf["_g"].iloc[0])
        return made

    return seats.groupBy("_g", "_s").applyInPandas(run, f"{group} {dict(cells.dtypes)[group]}, {out}")


def _in_order(cells: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """cells (group, cell, m: rows, and more) in the order of _separators by links (_g, lo, hi, w), plus pos, gap to the next and u, the stretch a ball lies
    in. One task a group, one row a ball and link."""
    out = ", ".join(f"{c} {t}" for c, t in cells.dtypes) + ", pos int, gap double, u int"

    def run(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _empty(_names(out))
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        order, gap = _separators(pdf["cell"].to_numpy(), list(zip(links["lo"].tolist(), links["hi"].tolist(), links["w"].tolist(), strict=True)))
        pdf = pdf.iloc[order]
        return pdf.assign(pos=np.arange(len(order)), gap=np.append(gap, np.inf), u=_numbered(pdf["m"].to_numpy()))[_names(out)]

    return cells.groupBy(group).cogroup(links.groupBy("_g")).applyInPandas(run, out)


def _numbered(m: np.ndarray) -> np.ndarray:
    """Stretches of balls of m rows each, in order."""
    n = int(m.sum())
    many = max(min(SPREAD, -(-n // (4 * BLOCK))), -(-n // SPAN))
    return (np.cumsum(m) - m) // -(-n // many)


def _met(packs: DataFrame, cells: DataFrame, todo: DataFrame, group: str, work, out: str) -> DataFrame:
    """work(packed balls of two stretches, todo between them) for each pair of stretches x <= y of todo (group, x, y and more); cells (group, cell, u)."""
    ends = todo.select(F.col(group).alias("_g"), "x", "y").distinct().select("_g", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("_u"))
    seats = large(cells.select(F.col(group).alias("_cg"), F.col("cell").alias("_c"), "u").join(ends, (F.col("_cg") == F.col("_g")) & (F.col("u") == F.col("_u"))).select("_g", "_c", "x", "y"))
    seats = packs.join(seats, (F.col(group) == F.col("_g")) & (F.col("cell") == F.col("_c"))).drop("_g", "_c")
    todo = todo.select(F.col(group).alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y"), *[c for c in todo.columns if c not in (group, "x", "y")])
    return _tasks(seats, group, "x", "y").groupBy(group, "x", "y").cogroup(_tasks(todo, "_g", "_x", "_y").groupBy("_g", "_x", "_y")).applyInPandas(work, out)


def core_distances(rows: DataFrame, group: str, need: int, block: int = BLOCK) -> DataFrame:
    """rows (a, group, v, n: how many equal ones there are), in balls, plus core: the distance to the need-th other row of the group, n of a row counted; to
    the farthest if there are fewer, 0 if there is none; and the nearest rows (near, apart: their distances), need + 2 of them. Exact: a row first looks into
    its own ball, then into the others that its radius so far reaches."""
    balls = into_balls(rows, group, block)
    kinds, keep = dict(balls.dtypes), need + 2
    pack = f"{group} {kinds[group]}, cell long, reach double, center array<double>, part int, a array<{kinds['a']}>, v binary, n binary, far binary, d binary, at binary"

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        v = np.stack(pdf["v"].to_numpy())
        near, at = np.full((len(v), keep), np.inf), np.full((len(v), keep), -1, np.int32)
        k = min(keep, len(v) - 1)
        for s in _slices(len(v), v.size) if k else ():
            d = _apart(v[s], v)
            d[np.arange(len(d)), np.arange(len(v))[s]] = np.inf
            some = np.argpartition(d, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(d, some, 1)
            near[s, :k], at[s, :k] = found, np.where(np.isfinite(found), some, -1)
        made = _packs(pdf, v, n=pdf["n"].to_numpy().astype(np.int64), far=pdf["far"].to_numpy(), d=near, at=at)
        return made.assign(**{group: pdf[group].iloc[0], "cell": pdf["cell"].iloc[0], "reach": near.max(), "center": [pdf["center"].iloc[0]] * len(made)})[_names(pack)]

    home = written(balls.groupBy(group, "cell").applyInPandas(at_home, pack), "home")
    cells = balls.groupBy(group, "cell").agg(F.first("center").alias("center"), F.max("far").alias("far"), F.count("*").alias("m"))
    reach = home.filter("part = 0").select(F.col(group).alias("_g"), F.col("cell").alias("_c"), "reach")
    cells = cells.join(reach, (F.col(group) == F.col("_g")) & (F.col("cell") == F.col("_c"))).select(group, "cell", "center", "far", "reach", "m")
    cells = written(cells, "cells")
    cells = written(_in_order(cells, _center_tree(cells, group).withColumnRenamed(group, "_g"), group), "stretches")

    def reached(own: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        one, two = np.stack(own["center"].to_numpy()), np.stack(every["center"].to_numpy())
        d = np.concatenate([_apart(one[s], two) for s in _slices(len(one), two.size)]) - own["far"].to_numpy()[:, None] - every["far"].to_numpy()
        i, j = np.nonzero((d - 1e-6 < own["reach"].to_numpy()[:, None]) & (own["cell"].to_numpy()[:, None] != every["cell"].to_numpy()))
        x, y = own["u"].to_numpy()[i], every["u"].to_numpy()[j]
        return pd.DataFrame({"cell": own["cell"].to_numpy()[i], "to": every["cell"].to_numpy()[j], "x": np.minimum(x, y), "y": np.maximum(x, y)})

    hops = written(_by_cells(cells, group, "cell long, to long, x int, y int", reached), "hops")
    seen = f"{group} {kinds[group]}, cell long, i binary, d binary, n binary, b array<{kinds['a']}>"

    def look(packs: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(packs) or not len(todo):
            return _empty(_names(seen))
        s, out = _Stretch(packs, n=np.int64, d=float), []
        near = s.d.reshape(-1, keep)
        near.sort(axis=1)
        ball = {c: s.ball(c) for c in s.at}
        for cell, to in todo.groupby("cell")["to"]:
            own = np.arange(s.at[cell].start, s.at[cell].stop)
            to = to.to_numpy()
            centers, far = np.stack([ball[c][0] for c in to]), np.array([ball[c][1] for c in to])
            first = np.argsort(((centers - ball[cell][0]) ** 2).sum(1), kind="stable")
            to, far = to[first].tolist(), far[first]
            spots = _squares(centers[first], s.v[0])
            least = np.sqrt(np.maximum(s.left[own] @ spots[1].T - s.slack - spots[2], 0)) - far - 1e-6
            best, what = near[own], np.full((len(own), keep), -1)
            for places, rows in s.runs(to):
                who = np.flatnonzero((least[:, places] < best[:, -1:]).any(1))
                if not len(who):
                    continue
                r, c = [], []
                for part in _slices(len(who), len(rows)):
                    w = who[part]
                    d = s.left[own[w]] @ s.right[rows].T
                    close = d <= _below(best[w, -1], s.slack)[:, None]
                    if np.count_nonzero(close) > 4 * keep * len(w) and len(rows) > keep:
                        close &= d <= _below(np.sqrt(np.maximum(np.partition(d, keep - 1, axis=1)[:, keep - 1], 0)), 2 * s.slack)[:, None]
                    i, j = np.nonzero(close)
                    r.append(w[i])
                    c.append(rows[j])
                r, c = np.concatenate(r), np.concatenate(c)
                if not len(r):
                    continue
                d = _between(s.v, own[r], c)
                hit = np.unique(r)
                key = np.concatenate([np.repeat(hit, keep), r])
                d, c = np.concatenate([best[hit].ravel(), d]), np.concatenate([what[hit].ravel(), c])
                order, place = _first_of_each(key, d)
                order, place = order[place < keep], place[place < keep]
                best[key[order], place], what[key[order], place] = d[order], c[order]
            r, k = np.nonzero((what >= 0) & np.isfinite(best))
            if len(r):
                c = what[r, k]
                out.append((cell, r.astype(np.int32).tobytes(), best[r, k].tobytes(), s.n[c].tobytes(), s.a[c]))
        return pd.DataFrame([(packs[group].iloc[0], *x) for x in out], columns=_names(seen)) if out else _empty(_names(seen))

    found = _met(home.select(group, "cell", "part", "a", "v", "n", "d"), cells, hops, group, look, seen)
    done = f"a {kinds['a']}, {group} {kinds[group]}, v array<double>, n long, cell long, center array<double>, far double, core double, near array<{kinds['a']}>, apart array<double>"

    def settled(packs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(packs):
            return _empty(_names(done))
        packs = packs.sort_values("part")
        a = np.concatenate(packs["a"].to_numpy())
        joined = lambda frame, c, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in frame[c]]])
        n, at = joined(packs, "n", np.int64), joined(packs, "at", np.int32)
        here = at >= 0
        r = np.concatenate([np.repeat(np.arange(len(a)), keep)[here], joined(found, "i", np.int32)])
        d = np.concatenate([joined(packs, "d", float)[here], joined(found, "d", float)])
        many = np.concatenate([n[at[here]], joined(found, "n", np.int64)])
        b = np.concatenate([a[at[here]], *found["b"].to_numpy()])
        order, place = _first_of_each(r, d, b)
        order, place = order[place < keep], place[place < keep]
        r = r[order]
        near, count = np.full((len(a), keep), np.inf), np.zeros((len(a), keep), np.int64)
        near[r, place], count[r, place] = d[order], many[order]
        reached = (n - 1)[:, None] + np.cumsum(count, 1) >= need
        size = np.bincount(r, minlength=len(a))
        last = np.where(reached.any(1), reached.argmax(1), size - 1)
        core = np.where((n - 1 >= need) | (size == 0), 0.0, near[np.arange(len(a)), last])
        stop = np.cumsum(size)[:-1]
        v = joined(packs, "v", float).reshape(len(a), -1)
        made = {"a": a, group: packs[group].iloc[0], "v": list(v), "n": n, "cell": packs["cell"].iloc[0], "center": [packs["center"].iloc[0]] * len(a), "far": joined(packs, "far", float), "core": core}
        return pd.DataFrame(made | {"near": np.split(b[order], stop), "apart": np.split(d[order], stop)})[_names(done)]

    found = found.withColumnRenamed(group, "_g").withColumnRenamed("cell", "_c")
    return written(home.groupBy(group, "cell").cogroup(found.groupBy("_g", "_c")).applyInPandas(settled, done), "cores")


def prim(v: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (i, j, w) of a minimum spanning tree of mutual reachability: the greatest of two cores and the distance. Of equal ones those with the lower ends."""
    n = len(v)
    best, near, todo, at, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool), 0, []
    for _ in range(n - 1):
        todo[at] = False
        w = np.maximum(np.maximum(np.round(np.sqrt(((v - v[at]) ** 2).sum(1)), DIGITS), core), core[at])
        closer = todo & ((w < best) | ((w == best) & (at < near)))
        best[closer], near[closer] = w[closer], at
        left = np.where(todo, best, np.inf)
        same = np.flatnonzero((left == left.min()) & todo)
        at = int(same[np.lexsort((np.maximum(same, near[same]), np.minimum(same, near[same])))[0]] if len(same) > 1 else same[0])
        out.append((near[at], at, best[at]))
    return np.array(out, float).reshape(-1, 3)


def _pair_trees(balls: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(group, a, b, w, one, two): a spanning tree of the rows of each pair of cells (group, lo, hi; lo = hi: of one cell); one and two: the ends' cells.
    Pairs between the same two neighbourhoods of balls are one task's work, so rows travel once a neighbourhood."""
    kinds = dict(balls.dtypes)
    out = f"{group} {kinds[group]}, a {kinds['a']}, b {kinds['a']}, w double, one long, two long"
    work = pairs.select(F.col(group).alias("_g"), "lo", "hi", F.shiftright("lo", NEAR).alias("_x"), F.shiftright("hi", NEAR).alias("_y"))
    ends = work.select("_g", "_x", "_y", F.explode(F.array(F.struct(F.col("lo").alias("c")), F.struct(F.col("hi").alias("c")))).alias("e")).select("_g", "_x", "_y", F.col("e.c").alias("_c")).distinct()
    seats = balls.select(group, "cell", "a", "v", "core").join(ends, (F.col(group) == F.col("_g")) & (F.col("cell") == F.col("_c")))

    def trees(rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(todo):
            return _empty(_names(out))
        rows = rows.sort_values("a").reset_index(drop=True)
        v, core, a, cell = np.stack(rows["v"].to_numpy()), rows["core"].to_numpy(), rows["a"].to_numpy(), rows["cell"].to_numpy()
        members, made = {c: np.flatnonzero(cell == c) for c in np.unique(cell)}, []
        for lo, hi in zip(todo["lo"], todo["hi"], strict=True):
            at = members[lo] if lo == hi else np.sort(np.concatenate([members[lo], members[hi]]))
            e = prim(v[at], core[at])
            made.append((at[e[:, 0].astype(int)], at[e[:, 1].astype(int)], e[:, 2]))
        i, j, w = (np.concatenate([m[k] for m in made]) for k in range(3))
        return pd.DataFrame({group: rows[group].iloc[0], "a": a[i], "b": a[j], "w": w, "one": cell[i], "two": cell[j]})

    todo = work.select("_g", F.col("_x").alias("_p"), F.col("_y").alias("_q"), "lo", "hi").groupBy("_g", "_p", "_q")
    return seats.select(group, "_x", "_y", "cell", "a", "v", "core").groupBy(group, "_x", "_y").cogroup(todo).applyInPandas(trees, out)


def _center_tree(cells: DataFrame, group: str) -> DataFrame:
    """(group, lo, hi, w): pairs of cells along a spanning tree of a group's centers. One task a group sees its centers, one for about BLOCK rows."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        e = prim(np.stack(pdf["center"].to_numpy()), np.zeros(len(pdf)))
        c, i, j = pdf["cell"].to_numpy(), e[:, 0].astype(int), e[:, 1].astype(int)
        return pd.DataFrame({group: pdf[group].iloc[0], "lo": np.minimum(c[i], c[j]), "hi": np.maximum(c[i], c[j]), "w": e[:, 2]})

    return cells.select(group, "cell", "center").groupBy(group).applyInPandas(tree, f"{group} {dict(cells.dtypes)[group]}, lo long, hi long, w double")


def _separators(cells: np.ndarray, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(order of cells, what parts each from the next): the least height at which two cells are joined is the greatest separator between them."""
    place = {int(c): i for i, c in enumerate(cells)}
    runs = [[i] for i in range(len(cells))]
    gaps: list[list[float]] = [[] for _ in runs]
    head = list(range(len(cells)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for lo, hi, w in sorted(edges, key=lambda e: e[2]):
        x, y = find(place[lo]), find(place[hi])
        if x == y:
            continue
        if len(runs[x]) < len(runs[y]):
            x, y = y, x
        runs[x] += runs[y]
        gaps[x] += [w, *gaps[y]]
        head[y] = x
    tops = [i for i in range(len(cells)) if head[i] == i]
    order = [i for t in tops for i in runs[t]]
    gap = [g for k, t in enumerate(tops) for g in ([np.inf] if k else []) + gaps[t]]
    return np.array(order), np.array(gap)


def tree_edges(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """rows (a, group, v, core) -> (group, a, b, w): edges that hold a minimum spanning tree of each group's mutual-reachability graph, the one that takes
    equal edges in order of their ends.

    Each ball gives its own tree, and balls that are neighbours along a tree of centers give trees of their rows together; with the nearest rows of each row
    they hold a tree that is nearly the one looked for. Two balls are joined at some height by its edges; if no row of one can be nearer to a row of the
    other than that, by their centers, radii and least cores, each edge between them would close a circle as its heaviest edge, and they need not meet. All
    other pairs of balls meet, and of their rows those pairs that are no farther than the tree's way between them; a task folds these into a forest.
    """
    balls = rows if "cell" in rows.columns else into_balls(rows, group, block)
    edges, _ = _tree(balls, group)
    return edges


def _grown(balls: DataFrame, first: DataFrame, few: DataFrame, group: str) -> DataFrame:
    """(group, a, b, w, one, two, h) of the groups in few (_g): the minimum spanning tree of the edges of `first` and those to the nearest rows, and a row
    for each row a (b is null) with the tree's greatest height on its way to one row, amid most others. One task a group, which holds no vectors."""
    kinds = dict(balls.dtypes)
    out = f"{group} {kinds[group]}, a {kinds['a']}, b {kinds['a']}, w double, one long, two long, h double"
    lists = ["near", "apart"] if "near" in balls.columns else []

    def grow(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("a")
        a, core, cell = rows["a"].to_numpy(), rows["core"].to_numpy(), rows["cell"].to_numpy()
        i, j, w = np.searchsorted(a, edges["a"].to_numpy()), np.searchsorted(a, edges["b"].to_numpy()), edges["w"].to_numpy()
        if lists:
            at = np.repeat(np.arange(len(a)), rows["near"].map(len))
            to = np.searchsorted(a, np.concatenate(rows["near"].to_numpy()))
            d = np.concatenate(rows["apart"].to_numpy())
            i, j, w = np.append(i, at), np.append(j, to), np.append(w, np.maximum(d, np.maximum(core[at], core[to])))
        i, j = np.minimum(i, j), np.maximum(i, j)
        kept = forest(len(a), i, j, w)
        i, j, w = i[kept], j[kept], w[kept]
        h = heights(len(a), i, j, w, heart(len(a), i, j))
        tree = pd.DataFrame({"a": a[i], "b": a[j], "w": w, "one": cell[i], "two": cell[j]})
        points = pd.DataFrame({"a": a, "one": cell, "h": h})
        return pd.concat([tree, points.assign(b=None)]).assign(**{group: rows[group].iloc[0]}).astype({"one": "Int64", "two": "Int64"})[_names(out)]

    rows = balls.select(group, "a", "core", "cell", *lists).join(few, F.col(group) == F.col("_g"), "left_semi")
    edges = first.select(F.col(group).alias("_eg"), "a", "b", "w").join(few, F.col("_eg") == F.col("_g"), "left_semi")
    return rows.groupBy(group).cogroup(edges.groupBy("_eg")).applyInPandas(grow, out)


def _tree(balls: DataFrame, group: str, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs of cells that met: group, lo, hi). Groups of more than `band` rows go without the tree of nearest rows."""
    cells = balls.groupBy(group, "cell").agg(F.first("center").alias("center"), F.max("far").alias("far"), F.min("core").alias("low"), F.count("*").alias("m"))
    cells = written(cells, "cells")
    few = cells.groupBy(F.col(group).alias("_g")).agg(F.sum("m").alias("_m")).filter(F.col("_m") <= band).select("_g")
    alone = cells.select(group, F.col("cell").alias("lo"), F.col("cell").alias("hi"))
    along = written(_center_tree(cells, group).select(group, "lo", "hi"), "along")
    first = written(_pair_trees(balls, alone.unionByName(along), group), "trees")
    grown = written(_grown(balls, first, few, group).unionByName(first.join(few, F.col(group) == F.col("_g"), "left_anti"), allowMissingColumns=True), "grown")
    start = grown.filter("b is not null")
    inside = first.filter("one = two").groupBy(F.col(group).alias("_g"), F.col("one").alias("_c")).agg(F.max("w").alias("_h"))
    hub = grown.filter("b is null").groupBy(F.col(group).alias("_g2"), F.col("one").alias("_c2")).agg(F.max("h").alias("_h2"))
    tops = cells.select(group, "cell").join(inside, (F.col(group) == F.col("_g")) & (F.col("cell") == F.col("_c")), "left").join(hub, (F.col(group) == F.col("_g2")) & (F.col("cell") == F.col("_c2")), "left")
    tops = written(tops.select(group, "cell", F.least(F.coalesce("_h", F.lit(0.0)), "_h2").alias("top")), "heights")
    cross = start.filter("one <> two").groupBy(group, F.least("one", "two").alias("lo"), F.greatest("one", "two").alias("hi")).agg(F.min("w").alias("w"))
    top = lambda c: tops.select(F.col(group).alias(f"_g{c}"), F.col("cell").alias(f"_c{c}"), F.col("top").alias(f"top_{c}"))
    cross = cross.join(top("lo"), (F.col(group) == F.col("_glo")) & (F.col("lo") == F.col("_clo"))).join(top("hi"), (F.col(group) == F.col("_ghi")) & (F.col("hi") == F.col("_chi")))
    links = cross.select(F.col(group).alias("_g"), "lo", "hi", F.greatest("w", "top_lo", "top_hi").alias("w"))
    numbered = written(_in_order(cells, links, group).select(group, "pos", "cell", "center", "far", "low", "gap", "u"), "order")
    done = along.select(F.col(group).alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    rest = _by_cells(numbered, group, "lo long, hi long, x int, y int, top double", _open_pairs)
    rest = written(rest.join(done, (F.col(group) == F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")), "left_anti"), "pairs")
    heard = grown.filter("b is null").select(F.col(group).alias("_g"), F.col("a").alias("_a"), "h")
    rows = balls.select(group, "cell", "a", "v", "core").join(large(heard), (F.col(group) == F.col("_g")) & (F.col("a") == F.col("_a")), "left").drop("_g", "_a")
    met = _met(_row_packs(rows, group), numbered.select(group, "cell", "u"), rest, group, *_meetings(dict(rows.dtypes), group))
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = start.select(group, *ends, "w").unionByName(met.select(group, *ends, "w"))
    return edges, along.unionByName(rest.select(group, "lo", "hi")).unionByName(alone)


def _row_packs(rows: DataFrame, group: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    out = f"{group} {kinds[group]}, cell long, part int, a array<{kinds['a']}>, v binary, core binary, h binary"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        made = _packs(pdf, np.stack(pdf["v"].to_numpy()), core=pdf["core"].to_numpy(), h=pdf["h"].fillna(np.inf).to_numpy())
        return made.assign(**{group: pdf[group].iloc[0], "cell": pdf["cell"].iloc[0]})[_names(out)]

    return rows.groupBy(group, "cell").applyInPandas(pack, out)


def _meetings(kinds: dict[str, str], group: str):
    """(work, schema) for _met: a forest of the edges between balls that are no heavier than what joins their ends already. Rows are joined at the greater of
    their ways to one row (h), and at `top` if that is known of their balls to be less."""
    out = f"{group} {kinds[group]}, a {kinds['a']}, b {kinds['a']}, w double"

    def meet(packs: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(packs) or not len(todo):
            return _empty(_names(out))
        s = _Stretch(packs, core=float, h=float)
        turn = np.empty(len(s.a), np.int64)
        turn[np.argsort(s.a, kind="stable")] = np.arange(len(s.a))
        kept, held, full = [], 0, FOLD

        def fold() -> None:
            nonlocal kept, held, full
            i, j, w = (np.concatenate([k[x] for k in kept]) for x in range(3))
            e = forest(len(s.a), i, j, w)
            kept, held = [(i[e], j[e], w[e])], len(e)
            full = held + FOLD

        for lo, to in todo.groupby("lo"):
            own = np.arange(s.at[lo].start, s.at[lo].stop)
            cells, tops = to["hi"].tolist(), to["top"].to_numpy()
            mine = _below(s.h[own], s.slack)[:, None]
            for places, rows in s.runs(cells):
                tops_of = np.repeat(tops[places], [s.at[cells[k]].stop - s.at[cells[k]].start for k in places])
                theirs, most = _below(s.h[rows], s.slack), _below(tops_of, s.slack)
                for part in _slices(len(own), len(rows)):
                    d = s.left[own[part]] @ s.right[rows].T
                    close = d <= mine[part]
                    close |= d <= theirs
                    close &= d <= most
                    r, c = np.nonzero(close)
                    if not len(r):
                        continue
                    i, j, top = own[part][r], rows[c], tops_of[c]
                    way = np.minimum(np.maximum(s.h[i], s.h[j]), top)
                    able = np.maximum(s.core[i], s.core[j]) <= way
                    i, j, way = i[able], j[able], way[able]
                    w = np.maximum(np.maximum(_between(s.v, i, j), s.core[i]), s.core[j])
                    able = w <= way
                    i, j, w = turn[i[able]], turn[j[able]], w[able]
                    kept.append((np.minimum(i, j), np.maximum(i, j), w))
                    held += len(w)
                    if held > full:
                        fold()
        if not held:
            return _empty(_names(out))
        fold()
        a = np.sort(s.a)
        return pd.DataFrame({group: packs[group].iloc[0], "a": a[kept[0][0]], "b": a[kept[0][1]], "w": kept[0][2]})

    return meet, out


def _open_pairs(own: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells, in order of pos, whose rows could be as near as the height at which they are joined (top); and their stretches."""
    c, far, low, gap, cell, u = np.stack(every["center"].to_numpy()), *(every[k].to_numpy() for k in ("far", "low", "gap", "cell", "u"))
    out = []
    for p in own["pos"].to_numpy():
        least = np.maximum(np.maximum(np.sqrt(((c[p + 1 :] - c[p]) ** 2).sum(1)) - far[p + 1 :] - far[p], low[p + 1 :]), low[p])
        joined = np.maximum.accumulate(gap[p:-1]) if len(gap) > p + 1 else np.zeros(0)
        q = p + 1 + np.flatnonzero(least - 1e-6 < joined)
        out.append(pd.DataFrame({"lo": np.minimum(cell[p], cell[q]), "hi": np.maximum(cell[p], cell[q]), "x": np.minimum(u[p], u[q]), "y": np.maximum(u[p], u[q]), "top": joined[q - p - 1]}))
    return pd.concat(out)


def condensed_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """Labels of a single-linkage tree by excess of mass: -1 is noise, clusters are numbered by their first point. Edges of a spanning forest over points
    0 .. n - 1; a cluster has at least `least` points; the whole set is no cluster. Trees that no edge joins stand infinitely far apart."""
    order = np.argsort(w, kind="stable")
    c = Condensed(least)
    c.merge(a[order].tolist(), b[order].tolist(), w[order].tolist(), {})
    tops = sorted({c.find(i) for i in range(n)})
    c.merge(tops[:-1], tops[1:], [1e12] * (len(tops) - 1), {})
    owner = np.full(n, -1)
    for i in range(n):
        owner[i] = c.cluster_of(i)
    above: dict[int, int] = {}
    for k in sorted(c.closed, reverse=True):  # parents have higher numbers
        up, chosen = c.closed[k]
        above[k] = above.get(up, -1) if above.get(up, -1) >= 0 else k if chosen else -1
    labels = np.array([above.get(k, -1) for k in owner])
    firsts = {k: int(np.argmax(labels == k)) for k in set(labels[labels >= 0].tolist())}
    number = {k: i for i, k in enumerate(sorted(firsts, key=firsts.get))}
    return np.array([number.get(k, -1) for k in labels.tolist()])


class Condensed:
    """A condensed tree, built from below. A component of fewer than `least` points is a bag; when it reaches that size, or meets a component that has, its
    points belong to an open cluster. Two components with clusters close both and open one above them. An open cluster sums the densities (1 / height)
    at which its points leave; its mass is that sum less its size times the density at which it closes."""

    def __init__(self, least: int, start: int = 0):
        self.least, self.next = max(2, least), start
        self.head: dict = {}
        #: component -> (points, its open cluster or -1, sum of densities, best masses below)
        self.node: dict = {}
        #: bag -> cluster; closed cluster -> (cluster above, whether it beats what is below)
        self.joined: dict = {}
        self.bags: dict = {}
        self.closed: dict[int, tuple[int, bool]] = {}

    def find(self, x):
        head = self.head
        while (up := head.get(x, x)) != x:
            head[x] = head.get(up, up)
            x = up
        return x

    def cluster_of(self, x) -> int:
        """The cluster that a point's bag joined first (-1: none): bags keep their heads, so the way up stops at the first that joined."""
        while x not in self.joined:
            up = self.bags.get(x, x)
            if up == x:
                return -1
            x = up
        return self.joined[x]

    def _close(self, cluster: int, n: int, mass: float, below: float, birth: float, up: int) -> float:
        mass -= n * birth
        chosen = mass >= below
        self.closed[cluster] = (up, chosen)
        return mass if chosen else below

    def merge(self, a: list, b: list, w: list, known: dict) -> None:
        """Edges in order of height; known: components of earlier merges (points, cluster, sum, below)."""
        for x, y, h in zip(a, b, w, strict=True):
            x, y = self.find(x), self.find(y)
            if x == y:
                continue
            (n1, c1, s1, b1), (n2, c2, s2, b2) = (self.node.get(k) or known.get(k) or (1, -1, 0.0, 0.0) for k in (x, y))
            n, dense = n1 + n2, 1 / max(h, 1e-12)
            if c1 < 0 and c2 >= 0:
                x, y, n1, c1, s1, b1, n2, c2 = y, x, n2, c2, s2, b2, n1, c1
            if c1 < 0:  # two bags
                if n >= self.least:
                    self.joined[x] = self.joined[y] = self.next
                    made = (n, self.next, n * dense, 0.0)
                    self.next += 1
                else:
                    self.bags[y] = x
                    made = (n, -1, 0.0, 0.0)
            elif c2 < 0:  # a bag leaves the cluster at this height
                self.joined[y] = c1
                made = (n, c1, s1 + n2 * dense, b1)
            else:
                up, self.next = self.next, self.next + 1
                below = self._close(c1, n1, s1, b1, dense, up) + self._close(c2, n2, s2, b2, dense, up)
                made = (n, up, n * dense, below)
            self.head[y] = x
            self.node.pop(y, None)
            self.node[x] = made


def _numbered_edges(tree: DataFrame, group: str) -> DataFrame:
    """tree (group, a, b, w) plus rank in its group by (w, a, b): ranges are sorted on their own and numbered by their counts."""
    ids = written(tree.repartitionByRange(group, "w", "a", "b").sortWithinPartitions(group, "w", "a", "b").withColumn("_id", F.monotonically_increasing_id()), "edges").withColumn("_p", F.shiftright("_id", 33))
    part = ids.groupBy(group, "_p").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    part = part.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    part = part.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_first", "_before")
    return ids.join(part, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_q"))).select(group, "a", "b", "w", (F.col("_id") - F.col("_first") + F.col("_before")).alias("rank"))


def _band(group: str, number: int, columns: list[str]):
    """Work on one band's edges and what is known of the components they touch: rows of (component, where it went, the cluster its bag joined), of components
    that are left, and of clusters that closed."""

    def run(e: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return _empty(columns)
        e = e.sort_values("rank")
        c = Condensed(int(e["least"].iloc[0]), number << 32)
        c.merge(e["a"].tolist(), e["b"].tolist(), e["w"].tolist(), {r.x: (int(r.n), int(r.own), float(r.mass), float(r.below)) for r in k.itertuples(index=False)})
        g, here = e[group].iloc[0], dict.fromkeys([*e["a"].tolist(), *e["b"].tolist()])
        rows = [(g, x, c.find(x), None if (j := c.cluster_of(x)) < 0 else j, None, None, None, None, None, None) for x in here]
        rows += [(g, x, None, None, n, mass, below, own, None, None) for x, (n, own, mass, below) in c.node.items()]
        rows += [(g, None, None, k, None, None, None, None, up, chosen) for k, (up, chosen) in c.closed.items()]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def banded_labels(tree: DataFrame, nodes: DataFrame, group: str, band: int = BAND) -> DataFrame:
    """(a, group, label) as condensed_labels gives them, for groups of any size: tree (group, a, b, w), one tree a group; nodes (a, group, least).

    The tree's edges are taken in bands of `band` in order of height. A band goes to one task a group, with what is known of the components it touches
    (points, open cluster, sums: one row each); it gives components anew, the clusters that bags joined and those that closed. Tables are written each
    round; there are edges / band rounds. Then each cluster looks up, by pointer jumping, to the highest chosen one above it.
    """
    kind_g, kind_a = dict(nodes.dtypes)[group], dict(nodes.dtypes)["a"]
    edges = written(_numbered_edges(tree, group).withColumn("band", F.floor(F.col("rank") / band).cast("int")), "bands")
    last = edges.agg(F.max("band")).first()[0]
    state = f"{group} {kind_g}, x {kind_a}, top {kind_a}, cluster long, n long, mass double, below double, own long, up long, chosen boolean"
    spark = nodes.sparkSession
    # seat: the component a node lies in now; parts: what is known of components of several nodes; owners: node -> cluster
    seat = nodes.select(group, F.col("a").alias("x"), F.col("a").alias("top"))
    parts = spark.createDataFrame([], f"{group} {kind_g}, x {kind_a}, n long, own long, mass double, below double")
    joined, closed = [], []
    least = nodes.groupBy(F.col(group).alias("_g")).agg(F.first("least").alias("least"))

    for number in range(-1 if last is None else last + 1):
        now = edges.filter(F.col("band") == number)
        at = lambda c: seat.select(F.col(group).alias(f"_g{c}"), F.col("x").alias(f"_x{c}"), F.col("top").alias(f"_{c}"))
        now = now.join(large(at("a")), (F.col(group) == F.col("_ga")) & (F.col("a") == F.col("_xa"))).join(large(at("b")), (F.col(group) == F.col("_gb")) & (F.col("b") == F.col("_xb")))
        now = written(now.join(least, F.col(group) == F.col("_g")).select(group, F.col("_a").alias("a"), F.col("_b").alias("b"), "w", "rank", "least"), "band")
        touched = now.select(group, F.explode(F.array("a", "b")).alias("x")).distinct()
        known = parts.join(touched, [group, "x"], "left_semi")

        out = written(now.groupBy(group).cogroup(known.groupBy(group)).applyInPandas(_band(group, number, _names(state)), state), "condensed")
        moved = out.filter("top is not null")
        joined.append(moved.filter("cluster is not null").select(group, F.col("x").alias("bag"), "cluster", F.lit(number).alias("turn")))
        closed.append(out.filter("chosen is not null").select(group, "cluster", "up", "chosen"))
        went = moved.select(F.col(group).alias("_g"), F.col("x").alias("_x"), F.col("top").alias("_t"))
        fresh = out.filter("n is not null").select(group, "x", "n", "own", "mass", "below")
        parts = written(parts.join(touched, [group, "x"], "left_anti").unionByName(fresh), "parts")
        # what a node's bag joined is settled here, once
        now_in = joined[-1].select(F.col(group).alias("_jg"), F.col("bag"), F.col("cluster").alias("_jc"))
        seat = seat.join(large(now_in), (F.col(group) == F.col("_jg")) & (F.col("top") == F.col("bag")), "left")
        owner = F.coalesce("owner", "_jc") if "owner" in seat.columns else F.col("_jc")
        seat = seat.join(large(went), (F.col(group) == F.col("_g")) & (F.col("top") == F.col("_x")), "left").select(group, "x", F.coalesce("_t", "top").alias("top"), owner.alias("owner"))
        seat = written(seat, "seats")
    if not closed:
        return nodes.select("a", group, F.lit(-1).cast("long").alias("label"))
    tops = closed[0]
    for c in closed[1:]:
        tops = tops.unionByName(c)
    # the highest chosen cluster above: up to the root, remembering the last chosen on the way
    jump = written(tops.select(group, "cluster", F.col("up").alias("to"), F.when(F.col("chosen"), F.col("cluster")).alias("best")), "jump")
    while True:
        far = jump.select(F.col(group).alias("_g"), F.col("cluster").alias("_c"), F.col("to").alias("_to"), F.col("best").alias("_best"))
        new = jump.join(far, (F.col(group) == F.col("_g")) & (F.col("to") == F.col("_c")), "left")
        new = written(new.select(group, "cluster", "_to", F.coalesce("_best", "best").alias("best"), F.col("_c").isNotNull().alias("go")).withColumnRenamed("_to", "to"), "jump")
        if new.filter("go").isEmpty():
            break
        jump = new.drop("go")
    best = jump.filter("best is not null").select(F.col(group).alias("_g"), F.col("cluster").alias("_c"), "best")
    found = seat.join(best, (F.col(group) == F.col("_g")) & (F.col("owner") == F.col("_c")), "left").select(group, F.col("x").alias("a"), "best")
    number = found.filter("best is not null").groupBy(group, "best").agg(F.min("a").alias("_f"))
    number = number.select(F.col(group).alias("_g"), F.col("best").alias("_b"), (F.row_number().over(Window.partitionBy(group).orderBy("_f")) - 1).cast("long").alias("_n"))
    return found.join(number, (F.col(group) == F.col("_g")) & (F.col("best") == F.col("_b")), "left").select("a", group, F.coalesce("_n", F.lit(-1)).cast("long").alias("label"))


def density_modes(df: DataFrame, group: str, idx: str, ipc: int, vec: str = "embedding", min_cluster_size: int = 15, min_samples: int = 3, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """(idx, group, label), label -1 for noise: density clusters of each group, numbered by their lowest idx. A cluster has min(min_cluster_size, max(rows of
    the group / ipc, 5)) rows at least; the core distance is that to the min_samples-th row, the row itself counted. Exact over all pairs of a group, of
    which only those meet that the balls don't rule out. Rows without a vector or a group are left out.
    """
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(F.col(idx).alias("a"), group, F.transform(vec, lambda x: x.cast("double")).alias("v"))
    classes = written(rows.groupBy(group, "v").agg(F.min("a").alias("rep"), F.count("*").alias("n")), "classes")
    cores = core_distances(classes.select(F.col("rep").alias("a"), group, "v", "n"), group, max(1, min_samples - 1), block)
    edges = written(_tree(cores, group, band)[0], "tree")
    # equal rows hang on their first one, at its core
    same = rows.join(large(classes.filter("n > 1").withColumnRenamed(group, "_g").withColumnRenamed("v", "_v")), (F.col(group) == F.col("_g")) & (F.col("v") == F.col("_v")) & (F.col("a") != F.col("rep")))
    core = cores.select(F.col("a").alias("_r"), F.col(group).alias("_cg"), "core")
    hung = same.select(group, "a", "rep").join(large(core), (F.col("rep") == F.col("_r")) & (F.col(group) == F.col("_cg"))).select(group, F.col("rep").alias("a"), F.col("a").alias("b"), F.col("core").alias("w"))
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    sizes = sizes.join(edges.groupBy(F.col(group).alias("_eg")).agg(F.count("*").alias("_e")), F.col("_g") == F.col("_eg"), "left").drop("_eg")
    many = (F.col("_n") > band) | (F.coalesce("_e", F.lit(0)) > 4 * max(band, FOLD))
    sizes = written(sizes.select("_g", F.least(F.lit(min_cluster_size), F.greatest(F.floor(F.col("_n") / ipc), F.lit(5))).cast("int").alias("least"), many.alias("_many")), "sizes")
    nodes = rows.select("a", group).join(sizes, F.col(group) == F.col("_g")).select("a", group, "least", "_many")
    small, tall = sizes.filter("not _many").select("_g"), sizes.filter("_many").select("_g")
    both = edges.unionByName(hung).join(small, F.col(group) == F.col("_g"), "left_semi").select(group, "a", "b", "w", F.lit(0).alias("least"))
    both = both.unionByName(nodes.filter("not _many").select(group, "a", F.col("a").alias("b"), F.lit(-1.0).alias("w"), "least"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["w"] < 0
        ids = np.sort(pdf.loc[own, "a"].to_numpy())
        t = pdf[~own]
        a, b, w = np.searchsorted(ids, t["a"].to_numpy()), np.searchsorted(ids, t["b"].to_numpy()), t["w"].to_numpy()
        e = forest(len(ids), a, b, w)
        labels = condensed_labels(len(ids), a[e], b[e], w[e], int(pdf["least"].max()))
        return pd.DataFrame({"a": ids, group: pdf[group].iloc[0], "label": labels})

    out = both.groupBy(group).applyInPandas(cut, f"a {kinds[idx]}, {group} {kinds[group]}, label long")
    if not tall.isEmpty():
        mine = edges.join(tall, F.col(group) == F.col("_g"), "left_semi")
        mst = spanning_forest(mine, group).join(large(cores.select("a", group)), "a").select(group, "a", "b", "w")
        mst = written(mst.unionByName(hung.join(tall, F.col(group) == F.col("_g"), "left_semi")), "tree")
        out = out.unionByName(banded_labels(mst, nodes.filter("_many").select("a", group, "least"), group, band))
    return out.select(F.col("a").alias(idx), group, "label")
