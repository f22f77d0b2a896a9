"""Matching a sample inventory with caption records by prioritized keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import normalize_relpath, string_or_none
from curatrix.session import written

KEYS = ("record_id", "sample_id", "relative_image_path")


def eligible(records: DataFrame) -> DataFrame:
    """Records whose status is null or success and that have a caption, with their keys cleaned into k_<key>."""
    ok = F.coalesce(string_or_none(F.col("render_status")), F.lit("success")) == "success"
    clean = {f"k_{k}": string_or_none(F.col(k)) if k == "record_id" else F.nullif(normalize_relpath(string_or_none(F.col(k))), F.lit("")) for k in KEYS}
    return records.withColumns(clean).filter(ok & string_or_none(F.col("canonical_caption")).isNotNull())


def dedupe_first_wins(records: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """The first row of each non-null key, by one pre-aggregated min_by (no window over a hot key)."""
    row = F.struct(*records.columns)
    return records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, line).alias("_r")).select("_r.*")


def dedupe_last_wins(records: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    row = F.struct(*records.columns)
    return records.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max_by(row, line).alias("_r")).select("_r.*")


def _sample_keys(samples: DataFrame) -> DataFrame:
    return samples.withColumns({"k_record_id": F.col("record_id"), "k_sample_id": normalize_relpath(F.col("sample_id")), "k_relative_image_path": normalize_relpath(F.col("sample_id"))})


def priority_match(samples: DataFrame, records: DataFrame) -> DataFrame:
    """samples with the record found by record_id, else sample_id, else relative path: match struct (null if none) and matched_via.

    Both sides are stacked by (kind of key, key), so one shuffle of the records and one of the keys find all matches, and the first kind that has one is
    taken per sample; samples themselves are joined once, by record_id and sample_id.
    """
    own = [c for c in samples.columns]
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k_{k}").alias("k")) for i, k in enumerate(KEYS)])
    good = eligible(records).select(F.struct(*records.columns, *[f"k_{x}" for x in KEYS]).alias("r"), "line_no", F.inline(kinds)).filter("k is not null")
    first = good.groupBy("kind", "k").agg(F.min_by("r", "line_no").alias("r"))
    keys = _sample_keys(samples).select(F.col("record_id").alias("_id"), F.col("sample_id").alias("_sid"), F.inline(kinds)).filter("k is not null").distinct()
    found = keys.join(first, ["kind", "k"]).groupBy("_id", "_sid").agg(F.min_by("r", "kind").alias("match"), F.min("kind").alias("_kind"))
    via = F.element_at(F.array(*map(F.lit, KEYS)), F.col("_kind") + 1)
    same = F.col("record_id").eqNullSafe(F.col("_id")) & F.col("sample_id").eqNullSafe(F.col("_sid"))
    return samples.join(found, same, "left").select(*own, "match", F.when(F.col("_kind").isNotNull(), via).alias("matched_via"))


def first_key(prefix: str = "k_") -> Column:
    return F.coalesce(*[F.col(f"{prefix}{k}") for k in KEYS])


@dataclass
class Pairing:
    pairs: DataFrame
    unmatched_left: DataFrame
    unmatched_right: DataFrame


def build_pairs(samples: DataFrame, records: DataFrame, strict: bool = False) -> Pairing:
    """Pairs, samples without a record, and eligible records whose key no pair used. strict: raise if any is left."""
    m = priority_match(samples, records)
    pairs = m.filter("match is not null").withColumn("effective_archetype", effective_archetype(F.col("match.archetype"), F.col("match.template_family"), F.col("archetype")))
    left = m.filter("match is null").drop("match", "matched_via").withColumn("reason", F.lit("no_matching_render_record"))
    used = m.filter("match is not null").select(first_key("match.k_").alias("_used")).filter("_used is not null").distinct()
    right = eligible(records).withColumn("_key", first_key()).filter("_key is not null").join(used, F.col("_key") == F.col("_used"), "left_anti")
    right = right.drop("_key", *[f"k_{k}" for k in KEYS]).withColumn("reason", F.lit("no_matching_image"))
    if strict and not (left.isEmpty() and right.isEmpty()):
        raise ValueError(f"strict matching failed: {left.count()} samples and {right.count()} records remain")
    return Pairing(pairs, left, right)


def effective_archetype(record: Column, family: Column, dataset: Column) -> Column:
    return F.coalesce(string_or_none(record), string_or_none(family), dataset)


def pairing_summary(p: Pairing) -> DataFrame:
    """(kind, k, n): pairs by class, archetype, template, strategy, in one pass of grouping sets; totals and mismatches."""
    cols = {"class": "class_name_raw", "archetype": "effective_archetype", "dataset_archetype": "archetype", "matched_via": "matched_via", "template": "template"}
    f = p.pairs.withColumn("template", F.col("match.template_family"))
    g = f.groupingSets([[c] for c in cols.values()], *cols.values()).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{k}") for k, c in cols.items()])
    kind = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, k) for k in cols])
    out = g.select(kind.alias("kind"), F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.col(c)) for k, c in cols.items()]).alias("k"), "n")
    total = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(k).alias("k"), "n")
    differs = f.filter(F.col("effective_archetype") != F.col("archetype"))
    return out.unionByName(total(f, "pairs")).unionByName(total(p.unmatched_left, "unmatched_left")).unionByName(total(p.unmatched_right, "unmatched_right")).unionByName(total(differs, "archetype_mismatch"))


def lookup_join(rows: DataFrame, mapping: DataFrame, key: str, out: str, default: Column) -> DataFrame:
    """rows plus out: the value of mapping (key, value; one row a key), else default. Left to the optimizer to broadcast by size."""
    m = mapping.select(F.col("key").alias("_mk"), F.col("value").alias("_mv"))
    return rows.join(m, F.col(key) == F.col("_mk"), "left").withColumn(out, F.coalesce("_mv", default)).drop("_mk", "_mv")


def anti_join(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def range_number(df: DataFrame, key: str, parts: int = 128) -> Column:
    """Number of the key's range, growing with the key. The bounds are quantiles of at most 256 * parts keys of lowest hash."""
    step = max(1, df.count() // (128 * parts))
    chosen = df.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(key).limit(256 * parts)
    keys = sorted(r[0] for r in chosen.collect())
    bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    return F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)


def numbered(df: DataFrame, keys: list[str], out: str = "idx") -> DataFrame:
    """df plus out: each row's place, from 0, in order of keys, the first of which must have no nulls. df is worked out once and written; ranges of the first
    key, cut at quantiles of a sample, are numbered by their counts, so no task sees all rows or all of a class. Rows that tie take any order."""
    df = written(df, "numbered")
    head = df.withColumn("_head", range_number(df, keys[0]))
    before = head.groupBy("_head").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_head").orderBy(*keys)) - 1 + F.col("_before")
    return head.join(before, "_head").select(*df.columns, place.cast("long").alias(out))


def pair_index(rendered: DataFrame, line: str = "line_no", inventory: DataFrame | None = None, root: str = "") -> DataFrame:
    """Dense index (idx) over records in order of record_id, with image_path, canonical_caption, class_name, class_name_raw, class_id and archetype.

    The last row of each id counts, and only if it is a success; ids without :: are left out. The image lies below root at what follows :: in the id; if the
    inventory (sample_id of the files that are there) lacks it, at the record's sample_id, where it has one. Without an inventory every file is taken to be
    there. Columns that rendered lacks have the reference's defaults: class_name the raw name, class_id 0, archetype empty.
    """
    last = dedupe_last_wins(rendered, "record_id", line).filter(F.contains(F.col("record_id"), F.lit("::")) & (F.col("render_status") == "success"))
    has = lambda c, default: F.coalesce(F.col(c), default) if c in last.columns else default
    parts = F.split("record_id", "::", 2)
    rows = last.withColumns({"_raw": parts[0], "_rel": parts[1]})
    there = F.lit(True)
    if inventory is not None:
        rows = rows.join(inventory.select(F.col("sample_id").alias("_file")).distinct(), F.col("_rel") == F.col("_file"), "left")
        there = F.col("_file").isNotNull()
    other = F.nullif(F.col("sample_id"), F.lit("")) if "sample_id" in last.columns else F.lit(None).cast("string")
    path = F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), F.when(there, F.col("_rel")).otherwise(F.coalesce(other, "_rel")))
    rows = rows.select("record_id", path.alias("image_path"), has("canonical_caption", F.lit("")).alias("canonical_caption"), has("class_name", F.col("_raw")).alias("class_name"), F.col("_raw").alias("class_name_raw"), has("class_id", F.lit(0)).cast("int").alias("class_id"), has("archetype", F.lit("")).alias("archetype"))
    return numbered(rows, ["record_id"]).select("idx", *rows.columns)
