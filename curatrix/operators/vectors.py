"""Grouped vector analytics on embeddings, given cluster labels: centroids, medoids, allocation, nearest modes, indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import written


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Mean vector of each group: components are averaged with pre-aggregation before the shuffle, so a hot group is no hot task."""
    parts = df.select(*keys, F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def medoids(df: DataFrame, keys: list[str], idx: str, vec: str = "embedding", digits: int = 6) -> DataFrame:
    """keys, medoid: idx of the member nearest to the mean (distances rounded, ties to the lowest idx), num_members, mean_dist, centroid."""
    d = df.join(centroids(df, keys, vec), keys).withColumn("_d", F.round(distance(F.col(vec), F.col("centroid")), digits))
    return d.groupBy(*keys).agg(F.min_by(idx, F.struct("_d", idx)).alias("medoid"), F.count("*").alias("num_members"), F.avg("_d").alias("mean_dist"), F.first("centroid").alias("centroid"))


def mode_stats(m: DataFrame, group: str) -> DataFrame:
    """medoids() plus weight (share of the group's rows) and density (inverse mean distance)."""
    total = F.sum("num_members").over(Window.partitionBy(group))
    return m.withColumns({"weight": F.round(F.col("num_members") / total, 4), "density": F.round(1 / F.greatest("mean_dist", F.lit(1e-8)), 4)})


def nearest(df: DataFrame, centers: DataFrame, group: str, label: str, idx: str, vec: str = "embedding", digits: int = 6) -> DataFrame:
    """(idx, group, label): the nearest center (centers: group, label, centroid; few a group) of each row, ties to the lowest label. A
    group's centers meet its rows as one array, so rows aren't multiplied or shuffled for the minimum."""
    packed = centers.groupBy(group).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("_c"))
    rows = df.select(idx, group, F.col(vec).alias("_v")).join(packed, group)
    far = F.transform("_c", lambda c: F.struct(F.round(distance(F.col("_v"), c["centroid"]), digits).alias("d"), c["label"].alias("label")))
    return rows.select(idx, group, F.array_min(far)["label"].alias(label))


def quota_allocation(sizes: DataFrame, group: str, label: str, n: str, ipc: int) -> DataFrame:
    """sizes (group, label, n) plus quota. At least ipc modes: one each for the first ipc; else one each, and the rest by size with
    largest remainders, ties to the lower label. The windows hold a group's modes, not its rows."""
    w = Window.partitionBy(group)
    k, total = F.count("*").over(w), F.sum(n).over(w)
    s = sizes.withColumns({"_k": k, "_rank": F.row_number().over(w.orderBy(label)), "_exact": F.col(n) / total * (F.lit(ipc) - k)})
    s = s.withColumn("_floor", F.floor("_exact"))
    s = s.withColumn("_left", F.lit(ipc) - F.col("_k") - F.sum("_floor").over(w))
    s = s.withColumn("_turn", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), label)))
    many = F.when(F.col("_rank") <= ipc, 1).otherwise(0)
    quota = F.when(F.col("_k") >= ipc, many).otherwise(1 + F.col("_floor") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0))
    return s.withColumn("quota", quota.cast("int")).drop("_k", "_rank", "_exact", "_floor", "_left", "_turn")


def _greedy(points: np.ndarray, n: int, digits: int) -> list[int]:
    """Places of n points: the first one, then always the farthest from all chosen, the first of equals; gaps are kept as a running minimum."""
    at, gap = [0], np.full(len(points), np.inf)
    while len(at) < min(n, len(points)):
        gap = np.minimum(gap, np.round(np.sqrt(((points - points[at[-1]]) ** 2).sum(1)), digits))
        gap[at] = -1
        at.append(int(gap.argmax()))
    return at


def farthest_point(centers: DataFrame, group: str, label: str, n: int, digits: int = 6, block: int = 8192) -> DataFrame:
    """(group, label, turn): greedy max-min choice of n centers (or all, if fewer) a group, from the lowest label; ties to the lowest label.

    A group of up to `block` centers is chosen in one Arrow pass. The centers of larger groups stay in a table that holds each one's gap to the nearest
    chosen center; a round reads and writes it once, so the plan doesn't grow with n and no task holds such a group.
    """
    c = centers.select(group, label, F.transform("centroid", lambda x: x.cast("double")).alias("centroid"))
    kinds = dict(c.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(label)
        at = _greedy(np.stack(pdf["centroid"].to_numpy()), n, digits)
        return pd.DataFrame({group: pdf[group].iloc[0], label: pdf[label].to_numpy()[at], "turn": np.arange(len(at))})

    def whole(df: DataFrame) -> DataFrame:
        return df.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {label} {kinds[label]}, turn int")

    sizes = c.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    many = [r["_g"] for r in sizes.limit(1).collect()]
    if not many:
        return whole(c)
    sizes = written(sizes, "groups")
    state = written(c.join(sizes, F.col(group) == F.col("_g"), "left_semi").withColumns({"_gap": F.lit(float("inf")), "turn": F.lit(None).cast("int")}), "gaps")
    for turn in range(n):
        pick = F.min_by(F.struct(label, "centroid"), label) if turn == 0 else F.max_by(F.struct(label, "centroid"), F.struct("_gap", (-F.col(label)).alias("x")))
        picked = state.filter("turn is null").groupBy(F.col(group).alias("_g")).agg(pick.alias("_p"))
        gap = F.least("_gap", F.round(distance(F.col("centroid"), F.col("_p.centroid")), digits))
        now = state.join(picked, F.col(group) == F.col("_g"), "left")
        state = written(now.select(group, label, "centroid", F.coalesce(gap, "_gap").alias("_gap"), F.when(F.col(label) == F.col(f"_p.{label}"), turn).otherwise(F.col("turn")).alias("turn")), "gaps")
    few = c.join(sizes, F.col(group) == F.col("_g"), "left_anti")
    return whole(few).unionByName(state.filter("turn is not null").select(group, label, "turn"))


def renumber(df: DataFrame, group: str, label: str) -> DataFrame:
    """df plus cluster_id: dense numbers of the non-negative labels of a group from 0; others get 0."""
    t = df.filter(F.col(label) >= 0).select(group, label).distinct().withColumn("cluster_id", F.dense_rank().over(Window.partitionBy(group).orderBy(label)) - 1)
    return df.join(t, [group, label], "left").fillna(0, ["cluster_id"])


def modes_index(stats: DataFrame, group: str, label: str) -> DataFrame:
    """stats plus global_mode_index over groups in order; as many rows as modes."""
    return stats.withColumn("global_mode_index", F.row_number().over(Window.orderBy(group, label)) - 1)


def class_summary(stats: DataFrame, group: str) -> DataFrame:
    return stats.groupBy(group).agg(F.count("*").alias("num_clusters"), F.sum("num_members").alias("num_samples"), F.array_join(F.array_sort(F.collect_list("num_members")), ",").alias("sizes"))
