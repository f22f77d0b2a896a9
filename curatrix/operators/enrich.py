"""Projections that enrich an inventory: metadata, archetypes, prompts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import dims


def infer_archetype(name: Column) -> Column:
    """The first archetype of which a keyword is part of the lower-cased name (inside words too), else the default."""
    out = F.lit(dims.DEFAULT_ARCHETYPE)
    for a, words in reversed(dims.KEYWORDS.items()):
        out = F.when(F.lower(name).rlike("|".join(words)), a).otherwise(out)
    return out


def slot_schema(archetype: Column) -> Column:
    """Ordered slots; null for an unknown archetype."""
    table = F.create_map(*[x for a, s in dims.SLOTS.items() for x in (F.lit(a), F.array(*map(F.lit, s)))])
    return F.try_element_at(table, archetype)


def require_archetypes(df: DataFrame, archetype: str) -> DataFrame:
    """df, or an error that names up to ten unknown archetypes."""
    bad = [r[0] for r in df.filter(slot_schema(F.col(archetype)).isNull()).select(archetype).distinct().limit(10).collect()]
    if bad:
        raise KeyError(f"unknown archetypes: {bad}")
    return df


def sample_metadata(samples: DataFrame, root: str) -> DataFrame:
    """Columns that every extracted row carries, but for the time."""
    return samples.withColumns({"dataset_root": F.lit(root), "split": F.element_at(F.split(F.lit(root.rstrip("/")), "/"), -1), "relative_image_path": F.col("sample_id"), "file_name": F.element_at(F.split("sample_id", "/"), -1)})


def build_prompt(class_name: Column, archetype: Column, guidance: dict[str, str] | None = None, default: str = "short visible value") -> Column:
    """Instructions for one sample: a header, a JSON template of its slots with guidance in their order, and the answer rules."""
    g = F.create_map(*[x for k, v in (guidance or {"viewpoint": "camera angle"}).items() for x in (F.lit(k), F.lit(v))])
    lines = F.transform(slot_schema(archetype), lambda s: F.concat(F.lit('    "'), s, F.lit('": "'), F.coalesce(F.try_element_at(g, s), F.lit(default)), F.lit('"')))
    body = F.concat(F.lit('{\n  "archetype": "'), archetype, F.lit('",\n  "attributes": {\n'), F.array_join(lines, ",\n"), F.lit("\n  }\n}"))
    return F.concat(F.lit("Class: "), class_name, F.lit("\nArchetype: "), archetype, F.lit("\nFill this template:\n"), body, F.lit("\nAnswer with JSON only. Write unknown for what can't be seen."))


def build_review_prompt(fields: DataFrame) -> DataFrame:
    """fields (record_id, slot, value, reasons, ..) plus prompt: the value in question and the other slots of its record as context, from a
    window over the record. Rows without a record id have no context and are left out."""
    pairs = F.collect_list(F.struct("slot", "value")).over(Window.partitionBy("record_id"))
    out = fields.filter(F.col("record_id").isNotNull()).withColumn("_all", F.map_from_entries(F.array_sort(pairs)))
    head = F.when(F.array_contains("reasons", dims.RECOVERY), "Recover a value for ").otherwise("Check the value of ")
    other = F.array_join(F.transform(F.map_entries(F.map_filter("_all", lambda k, v: k != F.col("slot"))), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return out.withColumn("prompt", F.concat(head, F.col("slot"), F.lit(": "), F.col("value"), F.lit("\nContext: "), other)).drop("_all")


def taxonomy_prompt(taxonomy: DataFrame) -> DataFrame:
    """taxonomy (name, definition, includes, excludes, notes) plus prompt; lists are cut to 4, 4 and 3."""
    part = lambda label, c, n: F.concat(F.lit(f"\n{label}: "), F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", "))
    return taxonomy.withColumn("prompt", F.concat("name", F.lit(": "), "definition", part("includes", "includes", 4), part("excludes", "excludes", 4), part("notes", "notes", 3)))


def generation_plan(modes: DataFrame, base_seed: int = 42) -> DataFrame:
    """modes (class_name_raw, class_name, cluster_id, global_mode_index, representative_caption) plus prompt, seed, file_name."""
    prompt = F.coalesce(F.nullif("representative_caption", F.lit("")), "class_name")
    return modes.withColumns({"prompt": prompt, "seed": F.lit(base_seed) + F.col("global_mode_index"), "file_name": F.concat("class_name_raw", F.lit("_mode"), F.format_string("%03d", F.col("cluster_id").cast("int")), F.lit(".png"))})


def epoch_schedule(ipc: Column, classes: Column, factor: int = 1) -> Column:
    """Training epochs by images per class: steps, two thirds for 100 classes, rounded down to hundreds."""
    n = ipc * factor * factor
    e = F.when(n == 1, 3000).when(n <= 10, 2000).when(n <= 50, 1500).when(n <= 200, 1000).when(n <= 500, 500).otherwise(300)
    e = F.when(classes == 100, F.floor(e * 2 / 3)).otherwise(e)
    return (e - e % 100).cast("int")


def limit_pairs(pairs: DataFrame, n: int, *order: str) -> DataFrame:
    return pairs.orderBy(*order).limit(max(0, n))
