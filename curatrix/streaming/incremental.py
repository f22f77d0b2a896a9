"""Incremental runs: new files in, results appended, failures retried, statistics carried on.

Each micro-batch writes its own folder batch=<id> by overwriting it, so a batch that is run twice leaves one result. What a later batch needs to
know of earlier ones is kept beside the results: an index of keys in hash buckets, of which a batch opens only those it has keys in, and counts that
are carried from batch to batch. Reading a sink means reading all batches; a record's latest row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of a sink's index of keys.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_sink(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """All batches of a sink with their batch number; empty before the first."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not _exists(spark, sink):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", sink).parquet(sink)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key from its highest batch."""
    own = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(own, "batch").alias("_r")).select("_r.*")


def todo(rows: DataFrame, results: DataFrame, key: str, status: str) -> DataFrame:
    """rows without a success among results: what failed before comes again."""
    return rows.join(results.filter(F.col(status) == "success").select(key).distinct(), key, "left_anti")


def last_of_batch(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the greatest by `order`, then by all its columns, so a rerun picks the same. Rows without a key are left out."""
    plain = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    by = F.struct(*[F.col(c) for c in [*order, *(c for c in plain if c not in order)]])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("_r")).select("_r.*")


class KeyIndex:
    """Status and counted columns of a sink's keys, in `<sink>_index/bucket=<hash>/batch=<id>`."""

    def __init__(self, spark: SparkSession, sink: str, schema: T.StructType, key: str, status: str, by: list[str], buckets: int):
        self.spark, self.path, self.key, self.status, self.by, self.buckets = spark, f"{sink}_index", key, status, by, buckets
        self.columns = list(dict.fromkeys([key, status, *by]))
        self.schema = T.StructType([*[schema[c] for c in self.columns], T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def known(self, rows: DataFrame, before: int) -> DataFrame:
        """What batches before `before` last said of the keys of rows. Only buckets that rows have keys in are opened."""
        wanted = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # `buckets` numbers at most
        fs, p = _fs(self.spark, self.path)
        made = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
        there = [f"{self.path}/bucket={b}" for b in wanted if f"bucket={b}" in made]
        if not there:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        found = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*there).filter(F.col("batch") < before)
        return latest(found.join(rows.select(self.key), self.key, "left_semi").drop("bucket"), self.key).select(*self.columns)

    def put(self, done: DataFrame, number: int) -> None:
        """Keys of a batch; a rerun of the batch replaces them."""
        rows = done.select(*self.columns).withColumns({"bucket": self.bucket(), "batch": F.lit(number).cast("long")})
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)


def run_incremental(
    spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str, status: str,
    stats: Callable[[DataFrame], DataFrame] | None = None, stats_path: str | None = None, files_per_batch: int = 100,
    by: tuple[str, ...] = (), order: tuple[str, ...] = (), buckets: int = BUCKETS,
) -> None:
    """Process what is new in the parquet folder source, then stop. process: rows -> rows with key and status, one a key. Keys that already succeeded are
    left out; of several new rows of a key the last by `order` counts. Rows without a key are left out.

    stats: counts (status, the columns `by`, n: keys whose latest row has them) -> a small table that replaces the one at stats_path, see read_current.
    Counts are those of the batch before plus what this batch changed. So a batch reads its rows, the index buckets of their keys and a table of
    counts, never the sink.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    out_schema = process(spark.createDataFrame([], schema)).schema
    index = KeyIndex(spark, sink, out_schema, key, status, list(by), buckets)
    counted = [F.col(c) for c in index.columns if c != key]

    def batch(rows: DataFrame, number: int) -> None:
        rows = last_of_batch(rows, key, list(order)).persist()
        known = index.known(rows, number).persist()
        out = f"{sink}/batch={number}"
        process(todo(rows, known, key, status)).write.mode("overwrite").parquet(out)
        done = spark.read.schema(out_schema).parquet(out)
        index.put(done, number)
        if stats and stats_path:
            gone = known.join(done.select(key), key, "left_semi").select(*counted, F.lit(-1).cast("long").alias("n"))
            new = done.select(*counted, F.lit(1).cast("long").alias("n")).unionByName(gone)
            if _exists(spark, f"{sink}_counts/batch={number - 1}"):
                new = new.unionByName(spark.read.schema(new.schema).parquet(f"{sink}_counts/batch={number - 1}"))
            new.groupBy(*counted).agg(F.sum("n").alias("n")).filter("n <> 0").coalesce(1).write.mode("overwrite").parquet(f"{sink}_counts/batch={number}")
            replace_atomically(stats(spark.read.schema(new.schema).parquet(f"{sink}_counts/batch={number}")).coalesce(1), stats_path)
        known.unpersist()
        rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_stats(counts: DataFrame) -> DataFrame:
    """extraction_stats from counts by class_name_raw and archetype."""
    ok = F.col("extraction_status") == "success"
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counts.agg(n(F.lit(True)).alias("total"), n(ok).alias("success"), n(~ok).alias("failed"), F.count_distinct("class_name_raw").alias("classes"), F.array_join(F.array_sort(F.collect_set("archetype")), ",").alias("archetypes"))


def normalize_stream(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, rules: dict | None = None) -> None:
    """Field normalization of a stream of long rows: it needs no state, each row stands for itself."""
    from curatrix.operators.normalize import normalize_fields

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rows = normalize_fields(spark.readStream.schema(schema).parquet(source), rules)
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that path has pointed to, newest last."""
    fs, p = _fs(spark, f"{path}/current")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def replace_atomically(df: DataFrame, path: str, keep: int = 2) -> None:
    """df becomes the table at path, for readers that go through read_current. It is written into a folder of its own, never touched again; then an empty
    file, whose name numbers and names that folder, is made beside those of earlier versions: the one step by which readers see the new table. Nothing
    is renamed, so this holds on object stores too; a crash before that step leaves the old table. The last `keep` versions stay for readers under way."""
    spark = df.sparkSession
    before = _pointers(spark, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    name = f"{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/versions/{name}")
    fs, pointer = _fs(spark, f"{path}/current/{name}")
    fs.create(pointer, False).close()
    for old in before[: max(0, len(before) + 1 - keep)]:
        fs.delete(_fs(spark, f"{path}/current/{old}")[1], False)
        fs.delete(_fs(spark, f"{path}/versions/{old}")[1], True)


def read_current(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest table that replace_atomically finished at path."""
    found = _pointers(spark, path)
    if not found:
        raise FileNotFoundError(f"no version at {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/versions/{found[-1]}")
