"""Sources and sinks: labelled folders, strict JSON lines, side tables, artifacts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.text import clean_key, trim

# Image suffixes.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def first_n_per_class(files: DataFrame, cls: str, path: str, n: int) -> DataFrame:
    """(cls, path): the first n (at least one) paths of each class. Each hash bucket of a class is ranked first, then its few survivors, so
    a class of any size is spread over tasks."""
    n = max(1, n)
    b = files.select(cls, path).withColumn("_b", F.pmod(F.xxhash64(path), F.lit(64)))
    first = b.withColumn("_r", F.row_number().over(Window.partitionBy(cls, "_b").orderBy(path))).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(path))).filter(F.col("_r") <= n).select(cls, path)


def scan_labeled_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """image_path, sample_id, class_name_raw, class_id of every image below root's class folders; contents aren't read. Class ids number the
    class folders in name order. No class or no image is an error."""
    root = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    at = F.regexp_extract("path", "^(?:[a-z]+:/{0,2})?(/.*)$", 1)
    rel = F.substring(at, len(root.split(":", 1)[-1].replace("//", "/")) + 2, 1 << 20)
    f = f.withColumn("sample_id", rel).filter(F.contains("sample_id", F.lit("/")))
    f = f.withColumn("class_name_raw", F.split("sample_id", "/", 2)[0])
    classes = f.select("class_name_raw").distinct().withColumn("class_id", F.row_number().over(Window.orderBy("class_name_raw")) - 1)
    images = f.filter(F.lower("sample_id").rlike(rf"\.({'|'.join(suffixes)})$")).join(classes, "class_name_raw")
    if images.isEmpty():
        raise ValueError(f"no images in class folders of {root}")
    return images.select(F.col("path").alias("image_path"), "sample_id", "class_name_raw", "class_id", "length", "modificationTime")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): a byte order mark and blank lines are skipped; lines that aren't one whole JSON object (single quotes or text after it
    are no JSON) or don't fit the schema go to errors (file, line_no from 1, line, error), or, if strict, raise with the first of them."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(trim(F.regexp_replace("value", "^﻿", "")).alias("line"), *where)
    parsed = lines.filter("line <> ''").withColumn("r", F.from_json("line", full, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})).withColumn("error", F.pandas_udf(json_error, "string")("line"))
    parsed = parsed.withColumn("error", F.coalesce("error", F.when(F.col("r._bad").isNotNull(), "does not fit the schema")))
    # a file's blocks are numbered by the lines of those before them
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bad = parsed.filter("error is not null").join(blocks, ["file", "block"])
    errors = bad.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line", "error")
    if strict and (first := errors.orderBy("file", "line_no").head()):
        raise ValueError(f"invalid JSON line {first['file']}:{first['line_no']}: {first['error']}: {first['line'][:200]}")
    return parsed.filter("error is null").select("r.*").drop("_bad"), errors


def json_error(lines: pd.Series) -> pd.Series:
    """Why a line isn't one JSON object; null if it is."""
    out = []
    for line in lines:
        try:
            out.append(None if isinstance(json.loads(line), dict) else "not an object")
        except ValueError as e:
            out.append(str(e))
    return pd.Series(out, dtype=object)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_string_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object whose values are all strings; anything else raises."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,variant>", {"mode": "FAILFAST"})).alias("key", "x")).withColumn("kind", F.schema_of_variant("x"))
    bad = rows.filter("kind <> 'STRING' or key is null").head()
    if bad:
        raise ValueError(f"value of {bad['key']} is {bad['kind']}, not a string")
    return rows.select("key", F.col("x").cast("string").alias("value"))


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    item = "array<struct<name:string,definition:string,includes:array<string>,excludes:array<string>,notes:array<string>>>"
    out = spark.read.option("multiLine", "true").schema(f"archetypes {item}").json(path).select(F.inline("archetypes"))
    if out.isEmpty() or not out.filter("coalesce(name, '') = ''").isEmpty():
        raise ValueError("a taxonomy needs archetypes, each with a name")
    return out


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file as a long table (section, key, value) with cleaned keys: entries of maps and, with null value, members of lists."""
    j = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    top = j.select("j", F.explode(F.json_object_keys("j")).alias("section")).withColumn("x", F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$['"), "section", F.lit("']"))))
    maps = top.filter("x like '{%'").select("section", F.explode(F.from_json("x", "map<string,string>")).alias("key", "value"))
    lists = top.filter("x like '[%'").select("section", F.explode(F.from_json("x", "array<string>")).alias("key"), F.lit(None).cast("string").alias("value"))
    return maps.unionByName(lists).withColumn("key", clean_key(F.col("key")))


def image_size(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, error) of the files below path; only their headers are read. Empty files are no rows, as Spark lists none."""
    from curatrix.sources.blobs import image_sizes, plain_path

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(plain_path(F.col("path")).alias("path"))
    return image_sizes(found)


#: Names that a summary lists.
SHOWN = 20


def materialize_training_set(pairs: DataFrame, folder: str, subdir: str = "images") -> DataFrame:
    """Copies each pair's image under a numbered safe name and writes metadata.jsonl and dataset_summary.json into folder; returns the summary's one row.

    pairs: image_path, canonical_caption, pair_id, record_id, sample_id, relative_image_path, class_name, class_name_raw, archetype (nulls are written as
    empty texts), numbered in order of record_id, then image_path. Tasks copy files in streams, each to a name of its own that is moved into place when it
    is whole. Missing sources are collected; if there is any, an error names the first of them and neither metadata nor summary is written.
    """
    from curatrix.functions.text import sanitize_copy_name
    from curatrix.operators.match import numbered
    from curatrix.session import written
    from curatrix.sources.blobs import copy_files, plain_path

    spark, folder = pairs.sparkSession, folder.rstrip("/")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pairs.select(plain_path(F.col("image_path")).alias("source"), text("canonical_caption").alias("text"), *[text(c).alias(c) for c in ("pair_id", "record_id", "sample_id", "relative_image_path", "class_name", "class_name_raw", "archetype")])
    base = F.element_at(F.split(F.coalesce("source", F.lit("")), "/"), -1)
    suffix = F.coalesce(F.nullif(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1), F.lit("")), F.lit(".png"))
    name = F.concat(F.format_string("%06d_", "idx"), sanitize_copy_name(F.when(F.col("relative_image_path") == "", base).otherwise(F.col("relative_image_path"))))
    name = F.when(F.lower(name).endswith(F.lower(suffix)), name).otherwise(F.concat(name, suffix))
    rows = numbered(rows, ["record_id", "source"]).withColumn("file_name", F.concat(F.lit(f"{subdir}/"), name))
    done = written(copy_files(rows.withColumn("target", F.concat(F.lit(f"{folder}/"), "file_name"))), "copied")
    bad = done.filter("error is not null")
    if first := bad.orderBy("idx").head():
        raise FileNotFoundError(f"{bad.count()} images can't be copied, the first is {first['source']}: {first['error']}")
    columns = ["file_name", "text", "pair_id", "record_id", "sample_id", "relative_image_path", "class_name", "class_name_raw", "archetype"]
    ordered = done.repartitionByRange("idx").sortWithinPartitions("idx").select(*columns)
    _one_file(ordered, f"{folder}/metadata.jsonl")
    head = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("idx") < SHOWN, F.struct("idx", "target")))), 1, SHOWN), lambda x: x["target"])
    summary = done.agg(F.count("*").alias("num_examples"), head.alias("copied_file_samples"))
    summary = summary.select("num_examples", F.lit(subdir).alias("image_subdir"), F.lit(f"{folder}/metadata.jsonl").alias("metadata_path"), F.lit(f"{folder}/{subdir}").alias("images_dir"), F.col("num_examples").alias("copied_file_count"), "copied_file_samples", (F.col("num_examples") > SHOWN).alias("truncated_copied_file_samples"))
    _one_file(summary, f"{folder}/dataset_summary.json")
    kept = spark.read.schema(summary.schema).json(f"{folder}/dataset_summary.json")
    return kept


def _one_file(df: DataFrame, path: str) -> None:
    """df as JSON lines in one file of that name; its one task reads the partitions one after the other. The file is written beside it and moved."""
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.parts")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    parts, target = hadoop(f"{path}.parts"), hadoop(path)
    fs = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next((f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")), None)
    fs.delete(target, True)
    if part is None:
        fs.create(target, True).close()
    elif not fs.rename(part, target):
        raise OSError(f"{part} can't be moved to {path}")
    fs.delete(parts, True)


def write_pairing(pairing, folder: str) -> None:
    """Manifest, both leftovers and the summary."""
    from curatrix.operators.match import pairing_summary

    for name, df in (("train_manifest", pairing.pairs), ("unmatched_images", pairing.unmatched_left), ("unmatched_render_records", pairing.unmatched_right)):
        write_jsonl(df, f"{folder}/{name}")
    write_summary(pairing_summary(pairing), f"{folder}/summary")
