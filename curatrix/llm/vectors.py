"""Operator 9: embedding near-duplicates by an exact metric range join around pivots.

Vectors are scaled to length one, where cosine c is the distance sqrt(2 - 2c), a metric. Each vector's home cell is that of its nearest
pivot. If x (home p) and y (home q) are within r, the triangle inequality gives d(x, q) <= d(x, p) + 2r, and, sharper, x lies within r of
the plane half-way between p and q; x visits the cells of higher number that pass. Cells join independently. In many dimensions vectors
without structure lie about equally far from every pivot and visit most cells; the join then compares most pairs, still exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import hot_join, materialize, table
from curatrix.llm.graph import components
from curatrix.llm.rangejoin import link

COSINE = 0.95
#: Vectors a pivot stands for, and pivots at most (they are fitted on that many vectors and sent to every task).
PER_PIVOT, PIVOTS = 4096, 256


def _unit(data, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small numbers would be lost
    return x / np.sqrt((x * x).sum(1))[:, None]


def _place(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each row, rows x pivots: whether it visits)."""
    d = np.maximum(0, 2 - 2 * (x @ pivots.T))
    home = d.argmin(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    own = d[np.arange(len(x)), home][:, None]
    near = (np.sqrt(d) <= np.sqrt(own) + 2 * r + 1e-7) & (d - own <= 2 * apart[home] * (r + 1e-7))
    return home, near & (np.arange(len(pivots)) > home[:, None])


def near(cosine: float):
    def hits(homes: np.ndarray, points: np.ndarray) -> np.ndarray:
        c = points.astype(np.float32) @ homes.astype(np.float32).T
        hit = c >= cosine
        i, j = np.nonzero(np.abs(c - cosine) < 1e-4)  # too near for single precision
        hit[i, j] = np.einsum("ij,ij->i", points[i], homes[j]) >= cosine
        return hit

    return hits


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of vectors (vec_id, embedding).

    Vectors link if their cosine, in double precision, is at least `cosine`. n_links counts the other rows linked directly, exact copies
    among them; component_id is the smallest vec_id reachable; kept marks it. Null embeddings, null ids, zero vectors and those with
    null or non-finite components link with nothing: no links, their own id as component. Vectors of different lengths never link.
    Equal vectors are joined once, with their number. Rows that share a vec_id are vectors of their own with links of their own; each is kept that
    has the smallest id of its component. An empty table gives no rows; other columns, whatever their names, are dropped.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = materialize(vectors.select("vec_id", F.when(fit, F.col("embedding")).alias("embedding")), "vectors")
    classes = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a class has an id of its own: rows of one vec_id can hold different vectors
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    first = classes.orderBy(F.xxhash64("rep"), "rep", F.xxhash64("embedding")).limit(min(PIVOTS, -(-n // PER_PIVOT))).select("embedding").toPandas()["embedding"]
    pivots = {m: _unit([np.asarray(v, kind).tobytes() for v in first if len(v) == m], kind) for m in {len(v) for v in first}}
    shift = {m: sum(len(p) for k, p in pivots.items() if k < m) for m in pivots}
    r = float(np.sqrt(2 - 2 * cosine))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [np.asarray(v, kind).tobytes() for v in b["embedding"]]
            b = b.assign(data=data, m=[len(d) // int(kind[2]) for d in data]).drop(columns="embedding")
            for m, part in b.groupby("m"):
                if m not in pivots:  # a length that no pivot has: one cell, cut into chunks
                    yield pd.DataFrame({"cell": -m, "visitor": False, "id": part["cls"], "data": part["data"], "weight": part["copies"]})
                    continue
                home, visits = _place(_unit(part["data"], kind), pivots[m], r)
                i, q = np.nonzero(visits)
                at = np.concatenate([np.arange(len(part)), i])
                cell, visitor = np.concatenate([home, q]) + shift[m], np.arange(len(at)) >= len(part)
                yield pd.DataFrame({"cell": cell, "visitor": visitor, "id": part["cls"].to_numpy()[at], "data": part["data"].to_numpy()[at], "weight": part["copies"].to_numpy()[at]})

    placed = materialize(classes.mapInPandas(place, "cell int, visitor boolean, id long, data binary, weight long"), "cells")
    found = materialize(link(placed, lambda s: _unit(s, kind), near(cosine), "long", count=True, chunk=PER_PIVOT), "links")
    groups = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("_r")).agg(F.sum("n").alias("links"))
    groups = materialize(groups.join(classes.select(F.col("cls").alias("id"), "rep"), "id"), "vector-groups")
    lowest = materialize(groups.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("copies")), "vector-lowest")
    low = hot_join(groups.select("id", "component"), lowest, "component", groups.count()).select("id", "low")
    facts = classes.join(links, F.col("cls") == F.col("_r"), "left").join(low, F.col("cls") == F.col("id"), "left")
    facts = materialize(facts.select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id")), "vector-facts")
    unfit = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    fine = rows.filter("embedding is not null")
    out = hot_join(fine, facts, "embedding", rows.count()).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(unfit)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of fit vectors of one length, then the ids reachable over links.
OP9_SQL = f"""with recursive fit as materialized (
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
    select a.vec_id x, b.vec_id y from fit a join fit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {COSINE}),
reach as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
low as (select x, min(y) y from reach group by x), counted as (select x, count(*) n from links group by x)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(low.y, vec_id)) component_id, vec_id = least(vec_id, coalesce(low.y, vec_id)) kept
from embeddings left join counted on counted.x = vec_id left join low on low.x = vec_id"""
