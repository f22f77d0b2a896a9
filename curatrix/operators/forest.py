"""Minimum spanning forests of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.session import written


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "forest")


def spanning_forest(edges: DataFrame, group: str, rounds: int = 40) -> DataFrame:
    """edges (group, a, b, w) -> (a, b, w) of a minimum spanning forest, by Boruvka rounds: each component's lightest outgoing edge, then
    the smallest label along the chosen edges. Lineage is cut every round."""
    e = _cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct())
    label = _cut(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("root", F.col("id")))
    kept = None
    for _ in range(rounds):
        la, lb = label.select(F.col("id").alias("a"), F.col("root").alias("ra")), label.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        out = _cut(e.join(la, "a").join(lb, "b").filter("ra <> rb"))
        if out.isEmpty():
            break
        both = out.select("a", "b", "w", "ra", "rb").union(out.select("a", "b", "w", F.col("rb"), F.col("ra")))
        pick = _cut(both.groupBy("ra").agg(F.min(F.struct("w", "a", "b", "rb")).alias("p")).select("ra", "p.*"))
        kept = pick.select("a", "b", "w").distinct() if kept is None else _cut(kept.union(pick.select("a", "b", "w")).distinct())
        up = _cut(pick.select("ra", F.when((F.col("rb") < F.col("ra")), F.col("rb")).otherwise(F.col("rb")).alias("to")))
        # two components that chose each other: the smaller stays
        back = up.select(F.col("ra").alias("to"), F.col("to").alias("ra2"))
        up = _cut(up.join(back, "to", "left").select("ra", F.when((F.col("ra2") == F.col("ra")) & (F.col("ra") < F.col("to")), F.col("ra")).otherwise(F.col("to")).alias("to")).groupBy("ra").agg(F.min("to").alias("to")))
        for _ in range(20):  # pointer jumping
            two = up.select(F.col("ra").alias("to"), F.col("to").alias("to2"))
            new = _cut(up.join(two, "to", "left").select("ra", F.coalesce("to2", "to").alias("to")))
            done = new.join(up.withColumnRenamed("to", "old"), "ra").filter("to <> old").isEmpty()
            up = new
            if done:
                break
        else:
            raise RuntimeError("labels did not settle")
        label = _cut(label.join(up.withColumnRenamed("ra", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
    else:
        raise RuntimeError(f"the forest did not settle in {rounds} rounds")
    return kept if kept is not None else e.limit(0)
