"""How the driver's tables stand in for a sample inventory: `part` rows are samples whose attribute values walk through a pool that makes
every rule act. The SQL texts say the same for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.session import table

ARCHETYPES = ["animal", "food_and_drink", "vehicle", "container", "structure_or_building", "weapon", "furniture"]
POOL = [
    None, "", "Unknown", " N/A ", " Red ", "red and white", "grey", "golden", "metallic", "wooden", "wood and metallic", "Metal / plastic",
    "wood, unknown", "front  view", "overhead", "rear 45 degrees", "held in hand", "being held by man", "resting , tilted", "standing, 2 people",
    "powered on", "Powered_off", "active", "curved", "large, boxy", "faces", "person holding", "outdoors", "neutral", "plate", "bridge tower", "gothic",
    "holster", "numbered", "café table", "long table with several items , displaying many labels", "object", "stationary", "cake", "yellowish+green",
    "side", "night time", "blurred", "at rest", "inactive", "ring", "mug", "off", "wet hair", "ocean side",
]
SIZE = len(POOL)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path, class_id.. of a sample, from part."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.split("p_name", " ")[i]
    kinds = F.array(*map(F.lit, ARCHETYPES))
    return p.select(
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("sample_id"),
        F.concat_ws("::", "p_brand", F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("record_id"),
        F.col("p_brand").alias("class_name_raw"),
        F.concat(word(1), F.lit(", "), F.lower("p_brand")).alias("class_name"),
        F.element_at(kinds, (F.col("p_partkey") % len(ARCHETYPES) + 1).cast("int")).alias("archetype"),
        "p_partkey",
        "p_name",
        "p_size",
        "p_type",
        "p_brand",
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, .., slot_pos, slot, raw_value: one row a sample and slot. Samples are spread by record first: a file of them is small for the
    work that its rows make, and what looks at a record's slots then needs no further shuffle."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    s = samples(spark, sf_dir).repartition(parts, "record_id")
    slots = F.create_map(*[x for a in ARCHETYPES for x in (F.lit(a), F.array(*map(F.lit, dims.SLOTS[a])))])
    pool = F.array(*[F.lit(v).cast("string") for v in POOL])
    long = s.select("record_id", "sample_id", "class_name", "class_name_raw", "archetype", "p_partkey", "p_size", F.posexplode(slots[F.col("archetype")]).alias("slot_pos", "slot"))
    return long.withColumn("raw_value", F.element_at(pool, ((F.col("p_partkey") * 13 + F.col("slot_pos") * 11 + F.col("p_size")) % SIZE + 1).cast("int"))).drop("p_size")


def _q(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


SAMPLES_SQL = f"""samples as (select p_brand || '/' || p_partkey || '.jpg' sample_id, p_brand || '::' || p_brand || '/' || p_partkey || '.jpg' record_id, p_brand class_name_raw,
  string_split(p_name, ' ')[2] || ', ' || lower(p_brand) class_name, {_list(ARCHETYPES)}[1 + p_partkey % {len(ARCHETYPES)}] archetype, p_partkey, p_name, p_size, p_type, p_brand from part)"""
ATTRIBUTES_SQL = f"""{SAMPLES_SQL},
attributes as (select record_id, sample_id, class_name, class_name_raw, archetype, p_partkey, i.i slot_pos,
  (case archetype {" ".join(f"when '{a}' then {_list(dims.SLOTS[a])}" for a in ARCHETYPES)} end)[i.i + 1] slot,
  {_list(POOL)}[1 + (p_partkey * 13 + i.i * 11 + p_size) % {SIZE}] raw_value from samples, (select unnest(range(7)) i) i)"""


def sql_clean(c: str) -> str:
    squashed = f"trim(regexp_replace(replace(trim({c}, ' \t\n'), '_', ' '), '\\s+', ' ', 'g'))"
    return f"coalesce(replace(lower(regexp_replace(regexp_replace({squashed}, '\\s*/\\s*', '/', 'g'), '\\s*,\\s*', ', ', 'g')), 'ß', 'ss'), 'unknown')"


def sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
