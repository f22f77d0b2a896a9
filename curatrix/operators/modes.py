"""From density labels to at most IPC modes a group: the second half of mode discovery, for all groups at once.

Groups go one of three ways, told apart by the number of modes found: K-Means where there are fewer than two, farthest-point choice and absorption where
there are more than IPC, shares of IPC by size otherwise. The ways are filters on one table of modes, and their rows meet again in one table of labels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.cluster import density_modes, group_kmeans, group_pca, subcluster
from curatrix.operators.vectors import centroids, farthest_point, nearest, quota_allocation
from curatrix.session import large, written

#: Names of the ways (fixed values of the results).
FALLBACK, CHOSEN, SHARED = "hdbscan_fallback_kmeans", "hdbscan_farthest_point", "hdbscan_proportional"


class Modes:
    """labels: (idx, group, label), consecutive from 0 in each group, at most IPC of them; worked out and written when first asked for.
    diagnostics: a row a group, see `assign_modes`; they don't depend on labels."""

    def __init__(self, make: Callable[[], DataFrame], diagnostics: DataFrame):
        self._make, self.diagnostics = make, diagnostics

    @cached_property
    def labels(self) -> DataFrame:
        return self._make()


def assign_modes(df: DataFrame, found: DataFrame, group: str, idx: str, ipc: int, vec: str = "embedding", reduced: DataFrame | None = None) -> Modes:
    """found (idx, group, label; -1 is noise) over the rows of df -> Modes.

    Noise goes to the nearest mode, by centers of `reduced` vectors (idx, group, vec; default df's). Everything after that works on df's vectors: the farthest
    IPC modes are chosen, the others go whole to the chosen one whose center is nearest before any of them moves, IPC is shared by size with largest
    remainders, and modes with a share over 1 are split by K-Means into as many parts, or as many as they have rows. Labels follow the order of choice, or of
    found labels, then the parts. diagnostics: branch, discovered, noise, discovered_sizes (before noise is given away, by label), sizes (after absorption, in
    the order of choice), allocation, subclustered (modes with a share over 1), kmeans_k. Null groups and rows without a vector are left out.
    """
    rows = df.filter(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(idx, group, vec)
    lean = rows if reduced is None else reduced.select(idx, group, vec)
    found = written(found.join(large(rows.select(idx, group)), [idx, group], "left_semi").select(idx, group, F.col("label").cast("long").alias("label")), "found")
    sizes = written(found.groupBy(group, "label").agg(F.count("*").alias("n")), "mode-sizes")
    pairs = F.array_sort(F.collect_list(F.when(F.col("label") >= 0, F.struct("label", "n"))))
    facts = sizes.groupBy(group).agg(F.count_if(F.col("label") >= 0).alias("discovered"), F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))), F.lit(0)).alias("noise"), F.sum("n").alias("rows"), F.transform(pairs, lambda p: p["n"]).alias("discovered_sizes"))
    facts = written(facts.withColumn("branch", F.when(F.col("discovered") < 2, FALLBACK).when(F.col("discovered") > ipc, CHOSEN).otherwise(SHARED)), "mode-facts")

    dense = found.join(facts.filter(F.col("branch") != FALLBACK).select(group), group, "left_semi")
    lean = dense.join(large(lean), [idx, group])
    lost = nearest(lean.filter("label < 0"), centroids(lean.filter("label >= 0"), [group, "label"], vec), group, "label", idx, vec)
    placed = written(dense.filter("label >= 0").unionByName(lost.select(idx, group, "label")).join(large(rows), [idx, group]), "placed")
    centers = written(centroids(placed, [group, "label"], vec).join(facts.select(group, "branch"), group), "mode-centers")

    crowded = centers.filter(F.col("branch") == CHOSEN)
    chosen = written(farthest_point(crowded, group, "label", ipc), "chosen")
    kept = crowded.join(chosen, [group, "label"])
    rest = crowded.join(chosen, [group, "label"], "left_anti").select(group, F.col("label").alias("_from"), F.col("centroid").alias(vec))
    absorbed = nearest(rest, kept.select(group, "label", "centroid"), group, "label", "_from", vec).join(chosen, [group, "label"])
    in_order = F.row_number().over(Window.partitionBy(group).orderBy("label")) - 1
    shared = centers.filter(F.col("branch") == SHARED).select(group, F.col("label").alias("_from"), in_order.alias("turn"))
    turns = written(shared.unionByName(chosen.select(group, F.col("label").alias("_from"), "turn")).unionByName(absorbed.select(group, "_from", "turn")), "turns")

    turned = placed.withColumnRenamed("label", "_from").join(turns, [group, "_from"]).select(idx, group, "turn", vec)
    quotas = written(quota_allocation(turned.groupBy(group, "turn").agg(F.count("*").alias("n")), group, "turn", "n", ipc), "quotas")
    few = facts.filter(F.col("branch") == FALLBACK).select(group, F.least(F.lit(ipc), F.col("rows")).cast("int").alias("kmeans_k"))

    def labels() -> DataFrame:
        plain = group_kmeans(rows.join(few, group), group, idx, "kmeans_k", vec)
        return written(subcluster(turned, quotas, group, "turn", idx, vec).unionByName(_dense(plain, group)), "mode-labels")

    shares = quotas.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("turn", "n", "quota"))).alias("_q"))
    seen = facts.join(shares, group, "left").join(few, group, "left")
    each = lambda name: F.transform("_q", lambda q: q[name])
    over = F.when(F.col("_q").isNotNull(), F.size(F.filter("_q", lambda q: q["quota"] > 1))).otherwise(0).cast("long")
    seen = seen.select(group, "branch", "rows", "discovered", "noise", "discovered_sizes", each("n").alias("sizes"), each("quota").alias("allocation"), over.alias("subclustered"), "kmeans_k")
    return Modes(labels, seen)


def _dense(labels: DataFrame, group: str) -> DataFrame:
    """Labels made consecutive; centers of K-Means can vanish."""
    used = labels.select(group, "label").distinct().withColumn("_to", F.row_number().over(Window.partitionBy(group).orderBy("label")) - 1)
    return labels.join(used, [group, "label"]).drop("label").withColumnRenamed("_to", "label").select(*labels.columns)


def discover_modes(df: DataFrame, group: str, idx: str, ipc: int, vec: str = "embedding", pca_dim: int = 50, **density) -> Modes:
    """At most IPC modes a group: density modes of the vectors, reduced to pca_dim numbers if they are longer (0: never), then `assign_modes`."""
    rows = df.filter(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(idx, group, vec)
    long = pca_dim and (rows.agg(F.max(F.size(vec))).first()[0] or 0) > pca_dim
    reduced = written(group_pca(rows, group, idx, pca_dim, vec) if long else rows, "reduced")
    found = written(density_modes(reduced, group, idx, ipc, vec, **density), "density")
    return assign_modes(rows, found, group, idx, ipc, vec, reduced)


def branch_rollup(diagnostics: DataFrame) -> DataFrame:
    """(branch, groups, subclustered): groups of each way and, in all, modes that were split."""
    return diagnostics.groupBy("branch").agg(F.count("*").alias("groups"), F.sum("subclustered").alias("subclustered"))
