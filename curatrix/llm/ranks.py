"""Seeded shuffles and running totals inside sources, without one task per source.

A source may hold a third of all rows, so nothing is windowed by source. Rows get a seeded 32-bit position from md5 of their doc_id and of
what else tells them apart, so that one id (or none) on many rows is spread too; each source is cut into buckets of equal position ranges
(about rows / (4 * shuffle partitions) rows each), bucket totals are summed in two levels over a table of at most 4 * partitions +
sources rows, and only the rows of one bucket are ever ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import partitions


def seeded_key(doc_id: Column, seed: int, rest: Column) -> Column:
    """rest: a hash of the row, for rows that share an id."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}#"), rest.cast("string")).cast("binary"))


def position(key: Column) -> Column:
    """The key's first 32 bits as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def running_total(df: DataFrame, group: str, rows_in_group: str, total_rows: int, key: str, then: list[str], size: str | None, out: str) -> DataFrame:
    """df plus `out`: the sum of size (None: 1 a row) up to and including the row, over its group's rows ordered by key, then.

    group: a column of non-null numbers; rows_in_group: a column with its group's row count. Rows that tie in all of key and
    then take their order arbitrarily.
    """
    spread = 4 * partitions(df.sparkSession)
    n = F.greatest(F.lit(1), F.ceil(F.col(rows_in_group) * spread / F.lit(max(1, total_rows))))
    one = F.lit(1).cast("long") if size is None else F.col(size)
    df = df.withColumn("_bucket", F.floor(position(F.col(key)) * n / F.lit(2**32)).cast("long"))
    low = df.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.sum(one).alias("_s"))
    upto = lambda *by: F.sum("_s").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    low = low.withColumn("_block", F.floor(F.col("_b") / 32))
    blocks = low.groupBy(F.col("_g").alias("_bg"), F.col("_block").alias("_bb")).agg(F.sum("_s").alias("_s"))
    blocks = blocks.select("_bg", "_bb", upto("_bg", "_bb").alias("_earlier"))
    low = low.withColumn("_inside", upto("_g", "_block", "_b")).join(blocks, (F.col("_g") == F.col("_bg")) & (F.col("_block") == F.col("_bb")))
    low = low.select("_g", "_b", (F.col("_earlier") + F.col("_inside")).alias("_before"))
    w = Window.partitionBy(group, "_bucket").orderBy(key, *then).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(low, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b"))).drop("_g", "_b")
    return joined.withColumn(out, F.sum(one).over(w) + F.col("_before")).drop("_bucket", "_before")


def linear_range(x: Column, parts: int) -> Column:
    """Number of x's range: parts of them to the unit up to 2, then as many to each doubling; grows with x."""
    return F.when(x <= 2, F.floor(x * parts)).otherwise(2 * parts + 1 + F.floor(F.log2(x / 2) * parts)).cast("long")


def range_offsets(df: DataFrame, range_col: str, size: Column) -> DataFrame:
    """(range, range_sum, range_end): totals of each range and of all up to it; a table of one row a range."""
    t = df.groupBy(range_col).agg(F.sum(size).alias("range_sum"))
    return t.withColumn("range_end", F.sum("range_sum").over(Window.orderBy(range_col).rowsBetween(Window.unboundedPreceding, 0)))
