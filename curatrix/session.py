"""Tables and session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", "8g")
    return b.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name where every executor sees it: in spark.checkpoint.dir or, on one machine only, in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base}/{label}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """df as a join's side of as many rows as the data: sorted and merged, never sent to the driver as a broadcast table. Files of ids and labels are
    so small for their rows that Spark's sizes would let them pass; and in rounds each broadcast takes the driver a page of memory, however few its rows."""
    return df.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, so that several readers work it out once."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
