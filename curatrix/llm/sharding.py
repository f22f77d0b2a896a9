"""Operator 5: sharding by proportional stratified interleaving.

Rows are shuffled by a seed within each source; a row's fractional rank is (rank - 1/2) / rows of its source. All rows in order of
fractional rank (then of source) are cut into runs whose lengths differ by one at most, so every run holds each source in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, partitions, row_hash, table, unused
from curatrix.llm.ranks import range_offsets, running_total, seeded_key

SHARDS, SEED = 24, 29


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rest: Column | None = None) -> DataFrame:
    """docs plus shard (0 to shards - 1) and slot (its place in the shard, gapless from 0).

    Needs doc_id and source. The seeded shuffle goes by doc_id and rest, a hash of the row. A null source is a source of its own; null and repeated ids and repeated rows are rows like any other;
    fewer rows than shards leave some shards empty; an empty table gives no rows. Columns of the same names are kept: the new ones
    then get trailing underscores.
    """
    n_shard, n_slot = unused(docs, "shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col("source").alias("_source"), seeded_key(F.col("doc_id"), seed, row_hash(docs) if rest is None else rest).alias("_key"), row_hash(docs).alias("_hash"))
    stats = keyed.groupBy("_source").agg(F.count("*").alias("_rows"))
    stats = materialize(stats.select(F.col("_source").alias("_s"), "_rows", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())).alias("_no")), "shard-sources")
    total = stats.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    ranked = running_total(keyed.join(stats, F.col("_source").eqNullSafe(F.col("_s"))), "_no", "_rows", total, "_key", ["_hash"], None, "_rank")
    ranked = ranked.withColumn("_part", (F.col("_rank") - F.lit(0.5)) / F.col("_rows"))
    ranked = materialize(ranked.withColumn("_range", F.floor(F.col("_part") * 4 * partitions(docs.sparkSession))).select("_row", "_no", "_part", "_range"), "shard-ranks")
    ends = materialize(range_offsets(ranked, "_range", F.lit(1).cast("long")).select("_range", (F.col("range_end") - F.col("range_sum")).alias("_before")), "shard-ranges")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_part", "_no")) - 1 + F.col("_before")
    placed = ranked.join(ends, "_range").withColumn("_place", place.cast("long"))
    no = F.floor(F.col("_place") * shards / F.lit(max(1, total)))
    # integer steps around the floating quotient make the cut exact
    no = F.when(F.col("_place") < F.ceil(no * F.lit(total) / shards), no - 1).when(F.col("_place") >= F.ceil((no + 1) * F.lit(total) / shards), no + 1).otherwise(no)
    return placed.select("_row.*", no.cast("int").alias(n_shard), (F.col("_place") - F.ceil(no * F.lit(total) / shards)).cast("long").alias(n_slot))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))
    s = shard(materialize(rows, "shard-rows"), rest=F.col("text_md5"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# crc32 bit by bit: entry i of the usual table is i shifted right eight times, with the polynomial where a one falls out.
_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
OP5_SQL = f"""
with recursive bits(i, c, k) as (select cast(range as bigint), cast(range as bigint), 0 from range(256) union all select i, {_STEP}, k + 1 from bits where k < 8),
crc as (select list(c order by i) t from bits where k = 8),
d as (select doc_id, source, coalesce(text, '') text from documents),
b as (select doc_id, source, text, cast(strlen(text) + 8 as bigint) size, hex(encode(text)) h from d),
s as (select doc_id, source, size, md5(coalesce(cast(doc_id as varchar), '') || '#{SEED}#' || md5(text)) k,
             xor(list_reduce(list_transform(range(1, len(h), 2), lambda p: cast('0x' || substr(h, p, 2) as bigint)),
                             lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), cast(4294967295 as bigint)), 4294967295) text_crc32 from b, crc),
n as (select source, count(*) n, row_number() over (order by source nulls last) no from s group by source),
r as (select s.*, no, (row_number() over (partition by no order by k) - 0.5::double) / n part from s join n on s.source is not distinct from n.source),
g as (select *, row_number() over (order by part, no) - 1 place, count(*) over () total from r),
f as (select *, cast(place * {SHARDS} // total as bigint) q from g),
e as (select *, case when place < ceil(q * total / {SHARDS}.0) then q - 1 when place >= ceil((q + 1) * total / {SHARDS}.0) then q + 1 else q end shard from f)
select doc_id, size, text_crc32, 'rows' law, cast(shard as int) shard, cast(place - ceil(shard * total / {SHARDS}.0) as bigint) slot, cast(null as int) grown_shard from e
"""
