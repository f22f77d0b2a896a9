"""Exact metric range joins over cells that join independently.

Every point has one home cell; a pair that lies in two cells meets because one of its points also visits the other's cell. Cells of
more than `chunk` homes are cut into chunks by a hash: visitors, and homes of lower chunks, go to each. A task loads a chunk's homes
(about `chunk` of them) and streams whatever visits it, so memory is bounded however dense a cell is. Where the caller knows which
chunks can hold a point's partners (`meets`), it goes to those only. Within a chunk, links are folded into a spanning forest as they
are found: a group of copies gives one edge a point, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, partitions

#: Rows that a home chunk holds on average at most; pairs compared at a time.
CHUNK, PAIRS = 2048, 1 << 20


def _step(homes: int) -> int:
    return max(16, PAIRS // max(1, homes))


class _Chunk:
    """The homes of one chunk, their links so far as components, and weighted link counts."""

    def __init__(self, ids: list, data: np.ndarray, weight: np.ndarray, near: Callable, count: bool, sure: Callable | None = None):
        self.ids, self.data, self.weight, self.near, self.count, self.sure = ids, data, weight, near, count, sure
        self.root, self.links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        self.out: list[tuple] = []
        step = _step(len(ids))
        for a in range(0, len(ids), step):
            b = min(len(ids), a + step)
            hit = near(data[:b], data[a:b])  # lower homes only: each pair once
            hit[:, a:] &= np.tri(b - a, k=-1, dtype=bool)
            self._fold(ids[a:b], hit, range(a, b), data[a:b])
            rows = np.flatnonzero(hit.any(1))
            if count and len(rows):
                self.links[a + rows] += hit[rows] @ weight[:b]
                self.links[:b] += weight[a + rows] @ hit[rows]

    def _fold(self, ids: list, hit: np.ndarray, own: range | None, data: np.ndarray) -> None:
        for k in np.flatnonzero(hit.any(1)):
            at = np.flatnonzero(hit[k])
            if self.sure:
                at = self._first_sure(at, data, k, None if own is None else self.root[own[k]])
            roots, first = np.unique(self.root[at], return_index=True)
            if own is not None:  # a home that an earlier one already joined needs no second edge
                mine = self.root[own[k]]
                first, roots = first[roots != mine], np.union1d(roots, [mine])
            self.out += [(ids[k], self.ids[at[i]], 0) for i in first]
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]

    def _first_sure(self, at: np.ndarray, data: np.ndarray, k: int, mine: int | None) -> np.ndarray:
        """Of the homes at, one of each component but mine that surely links to point k, where there is one."""
        out, done = [], {mine}
        for i, r in zip(at.tolist(), self.root[at].tolist(), strict=True):
            if r not in done and self.sure(self.data, i, data, k):
                out.append(i)
                done.add(r)
        return np.array(out, np.int64)

    def visit(self, ids: list, data: np.ndarray, weight: np.ndarray) -> None:
        hit = self.near(self.data, data)
        self._fold(ids, hit, None, data)
        rows = np.flatnonzero(hit.any(1))
        if self.count and len(rows):
            self.links += weight[rows] @ hit[rows]
            self.out += [(ids[k], None, int(n)) for k, n in zip(rows, hit[rows] @ self.weight, strict=True)]

    def close(self) -> list[tuple]:
        return self.out + [(self.ids[k], None, int(self.links[k])) for k in np.flatnonzero(self.links)]


def chunks(placed: DataFrame, chunk: int = CHUNK, meets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """placed (cell, visitor, id, data, weight) -> (cell, chunk, visitor, id, data, weight): each home in its chunk, and in or with every
    other chunk of its cells that it has to meet. meets, if given, takes seats (id, data, cell, own: a home's chunk, -1 for visitors) to (id, cell,
    chunk), each once: the chunks above own that can hold a point's partners."""
    size = placed.filter("not visitor").groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    seats = placed.join(materialize(size, "cells"), "cell")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    seats = seats.withColumn("own", F.when(F.col("visitor"), F.lit(-1)).otherwise(own))
    if meets is None:
        seats = seats.withColumn("chunk", F.explode(F.sequence(F.when(F.col("visitor"), F.lit(0)).otherwise(F.col("own")), F.col("chunks") - 1)))
    else:
        homes = seats.filter("not visitor").withColumn("chunk", F.col("own"))
        visits = seats.join(meets(seats.select("id", "data", "cell", "own")), ["id", "cell"])
        seats = homes.unionByName(visits)
    return seats.select("cell", "chunk", (F.col("chunk") != F.col("own")).alias("visitor"), "id", "data", "weight")


def link(
    placed: DataFrame,
    parse: Callable[[pd.Series], np.ndarray],
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    id_type: str,
    count: bool = False,
    chunk: int = CHUNK,
    sure: Callable | None = None,
    meets: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """placed (cell, visitor, id, data binary, weight long) -> (a, b, n): edges of a spanning forest of each chunk's links with n = 0
    and, if count, rows with null b whose n sum, by a, to the weights of the points linked to a.

    parse turns data into rows of an array; near(homes, points) says, as a matrix of points x homes, which pairs are links.
    sure(homes, i, points, k), if given (without count), decides about a pair that near names; it is asked only while the pair's ends are apart.
    meets, if given, names the chunks in which a point can have partners (see chunks).
    """
    return joined(chunks(placed, chunk, meets), parse, near, id_type, count, sure)


def joined(seats: DataFrame, parse: Callable, near: Callable, id_type: str, count: bool = False, sure: Callable | None = None) -> DataFrame:
    """What link gives, of seats that are dealt to chunks already (cell, chunk, visitor, id, data, weight)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, homes, open_chunk = None, [], None

        def start() -> _Chunk | None:
            if not homes:
                return None
            h = pd.concat(homes)
            return _Chunk(list(h["id"]), parse(h["data"]), h["weight"].to_numpy(np.int64), near, count, sure)

        def frames(out: list[tuple]) -> Iterator[pd.DataFrame]:
            if out:
                yield pd.DataFrame({"a": [x[0] for x in out], "b": pd.Series([x[1] for x in out], dtype=object), "n": [x[2] for x in out]})

        for batch in batches:
            turn = (batch["cell"].diff().fillna(1) != 0) | (batch["chunk"].diff().fillna(1) != 0) | (batch["visitor"].astype(int).diff().fillna(1) != 0)
            for _, b in batch.groupby(turn.cumsum().to_numpy(), sort=False):
                now = (b["cell"].iat[0], b["chunk"].iat[0])
                if now != key:
                    if key is not None and (open_chunk := open_chunk or start()):
                        yield from frames(open_chunk.close())
                    key, homes, open_chunk = now, [], None
                if not b["visitor"].iat[0]:
                    homes.append(b)
                    continue
                open_chunk = open_chunk or start()
                if open_chunk is None:
                    continue
                step = _step(len(open_chunk.ids))
                for at in range(0, len(b), step):
                    v = b.iloc[at : at + step]
                    open_chunk.visit(list(v["id"]), parse(v["data"]), v["weight"].to_numpy(np.int64))
                yield from frames(open_chunk.out)
                open_chunk.out = []
        if key is not None and (open_chunk := open_chunk or start()):
            yield from frames(open_chunk.close())

    n = partitions(seats.sparkSession)
    sorted_seats = seats.repartition(n, "cell", "chunk").sortWithinPartitions("cell", "chunk", "visitor")
    return sorted_seats.mapInPandas(run, f"a {id_type}, b {id_type}, n long")
