"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/DuckDB class of the six ASCII white-space characters; words are the runs between them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder every executor sees: spark.checkpoint.dir where the session names one, else, on one machine only, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = tempfile.mkdtemp(prefix="curatrix-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and gives Catalyst true sizes
    (a later join broadcasts the table only if it is under spark.sql.autoBroadcastJoinThreshold)."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives what the driver's Python has freed, as after a training, back to the system; a C library that can't keeps it."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, side: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined to side, which has one row a value of `on` with the number of its rows as `copies`. Values that hold more than
    1 / (4 * shuffle partitions) of all `total` rows, of which there are fewer than 4 * shuffle partitions, are broadcast; so no task gets
    more than that share of the others for one value."""
    hot = F.col("copies") * 4 * partitions(rows.sparkSession) > total
    few = F.broadcast(side.filter(hot))
    rest = rows.join(few.select(on), on, "left_anti").join(side.filter(~hot), on)
    return rows.join(few, on).unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of WORD runs; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64 bits of the whole row. Rows that agree in it and in doc_id are taken for repeats of one row."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(*cols)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id: Column) -> Column:
    """Labels of these rows are never learnt from: crc32 of the id's decimal text leaves 1 when divided by 3 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """At most per_class labelled rows of each class (0, 1), lowest hash of doc_id first, none of them held out: (doc_id, text, y).

    The ids are 2 * per_class at most whatever the input, so broadcasting them is safe. Null labels and ids are skipped; a doc_id
    with several labels takes the largest; a doc_id with several rows takes the smallest text.
    """
    y = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max(target).alias("y"))
    first = lambda k: y.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = first(0).unionByName(first(1))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
