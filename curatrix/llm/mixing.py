"""Operator 1: mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a seed and laid end to end, as often as max_repeats allows. A copy's virtual finish time is
the source's words up to and including it, divided by the source's target. The mix is all copies in order of finish time (then of
source), cut where its words would pass the budget. Targets share the budget by weight; none passes max_repeats times its source's
size, and what it leaves is shared by weight among the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, partitions, row_hash, table, unused, word_count
from curatrix.llm.ranks import linear_range, range_offsets, running_total, seeded_key

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The budget as hundredths of all sizes, and the most times a document is taken.
BUDGET_PERCENT, MAX_REPEATS, SEED = 150, 2, 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_rows, source_size) -> the same plus source_no (from 1, by code point, null last), weight, target double.

    A table of one row a source. In order of the size a unit of weight can supply, the first sources are capped; the level of the
    others is what the caps leave, divided by their weights. All sums are whole numbers, so the result doesn't depend on their order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_no", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1).cast("long"))
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("_all", F.sum("source_size").over(everywhere)).withColumn("_w", F.sum("weight").over(everywhere))
    supply = F.col("cap") / F.col("weight")
    before = Window.orderBy(supply, "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_all") * budget_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.col("_w") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("_level", left / (rest * 100))
    level = F.max(F.when(F.col("_level") < supply, F.col("_level"))).over(everywhere)
    s = s.withColumn("target", F.when(level.isNull() | (supply <= level), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return s.select("source", "source_no", "source_rows", "source_size", "weight", "target")


@dataclass
class Cut:
    """The last copy that the mix takes: its finish time and its source's number; nothing is taken where finish is None."""

    finish: float | None
    source_no: int


def _finish(prefix: Column, copy: Column, size: Column, target: Column) -> Column:
    """Virtual finish time of a document's copy (0, 1, ..); null where the source has no target."""
    return F.when(target > 0, (copy * size + prefix) / target)


def cut(prefixes: DataFrame, total: int, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> Cut:
    """prefixes (source_no, source_size, target, size, prefix): where the globally sorted mix passes the budget.

    The copies are range-partitioned by finish time into about 4 * shuffle partitions ranges; range totals locate the one range that
    holds the cut, and only its copies are sorted.
    """
    copies = prefixes.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("finish", _finish(F.col("prefix"), F.col("copy"), F.col("source_size"), F.col("target"))).filter("finish is not null")
    copies = copies.withColumn("range", linear_range(F.col("finish"), 4 * partitions(prefixes.sparkSession)))
    over = 100 * F.col("range_end") > total * budget_percent
    ends = range_offsets(copies, "range", F.col("size"))
    at = ends.agg(F.min(F.when(over, F.col("range"))).alias("range"), F.min(F.when(over, F.struct("range", F.col("range_end") - F.col("range_sum")))).alias("s")).first()
    last = lambda df: df.agg(F.max(F.struct("finish", "source_no")).alias("m")).first()["m"]
    if at["range"] is None:
        m = last(copies)
    else:
        before = at["s"][1]
        inside = copies.filter(F.col("range") == at["range"])
        upto = F.sum("size").over(Window.partitionBy("range").orderBy("finish", "source_no").rowsBetween(Window.unboundedPreceding, 0))
        m = last(inside.withColumn("upto", upto).filter((F.col("upto") + F.lit(before)) * 100 <= total * budget_percent))
        m = m or last(copies.filter(F.col("range") < at["range"]))
    return Cut(m["finish"], m["source_no"]) if m else Cut(None, 0)


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS, seed: int = SEED, rest: Column | None = None) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target, mix_finish (of the first copy) and mix_copies (times the mix takes the row).

    Needs doc_id, source and text (or a size column expression). The seeded shuffle goes by doc_id and rest, a hash of the row. Null sources are a source of their own, the last; null or empty
    texts have size 0 and are taken as often as their place in the queue says; a null doc_id sorts by the empty string; repeated rows
    are queued one by one; an empty table gives no rows. Columns of the same names are kept: new ones then get trailing underscores.
    """
    spark = docs.sparkSession
    n_size, n_total, n_target, n_finish, n_copies = unused(docs, "mix_size", "mix_source_size", "mix_target", "mix_finish", "mix_copies")
    own = docs.columns
    size = word_count(F.col("text")) if size is None else size
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    keyed = docs.select(row, F.col("source").alias("_source"), seeded_key(F.col("doc_id"), seed, row_hash(docs) if rest is None else rest).alias("_key"), row_hash(docs).alias("_hash"), size.cast("long").alias("size"))
    ids = materialize(keyed.drop("_row"), "mix-ids")
    by_source = ids.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    stats = materialize(targets(by_source, weights, budget_percent, max_repeats), "mix-sources")
    whole = stats.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()

    def queued(rows: DataFrame) -> DataFrame:
        s = stats.withColumnRenamed("source", "_s")
        return running_total(rows.join(s, F.col("_source").eqNullSafe(F.col("_s"))), "source_no", "source_rows", whole["n"], "_key", ["_hash", "size"], "size", "prefix")

    end = cut(materialize(queued(ids).select("source_no", "source_size", "target", "size", "prefix"), "mix-queue"), whole["s"], budget_percent, max_repeats)
    at = lambda k: _finish(F.col("prefix"), F.lit(k), F.col("source_size"), F.col("target"))
    inside = lambda k: (at(k) < end.finish) | ((at(k) == end.finish) & (F.col("source_no") <= end.source_no)) if end.finish is not None else F.lit(False)
    copies = sum((F.coalesce(inside(k), F.lit(False)).cast("int") for k in range(max_repeats)), F.lit(0))
    return queued(keyed).select("_row.*", F.col("size").alias(n_size), F.col("source_size").alias(n_total), F.col("target").alias(n_target), at(0).alias(n_finish), copies.alias(n_copies))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    m = mix(materialize(docs, "mix-sizes"), F.col("size"), rest=F.col("text_md5"))
    return m.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))


OP1_SQL = f"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size,
                  md5(coalesce(cast(doc_id as varchar), '') || '#{SEED}#' || md5(coalesce(text, ''))) k from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) no from d group by source),
w as (select *, [{", ".join(map(str, WEIGHTS))}][1 + (no - 1) % {len(WEIGHTS)}] weight, {MAX_REPEATS} * source_size cap from s),
v as (select *, cast(cap as double) / weight supply,
             cast(sum(source_size) over () * {BUDGET_PERCENT} - 100 * coalesce(sum(cap) over o, 0) as double) / cast((sum(weight) over () - coalesce(sum(weight) over o, 0)) * 100 as double) lv
      from w window o as (order by cast(cap as double) / weight, no rows between unbounded preceding and 1 preceding)),
t as (select *, max(case when lv < supply then lv end) over () l from v),
g as (select source, no, source_size, case when l is null or supply <= l then cast(cap as double) else l * weight end target from t),
q as (select d.doc_id, d.size, g.no, g.source_size, g.target, sum(d.size) over (partition by g.no order by k, d.doc_id, d.size rows unbounded preceding) p
      from d join g on d.source is not distinct from g.source),
c as (select q.*, e.e, cast(e.e * source_size + p as double) / target f from q, (select unnest(range({MAX_REPEATS})) e) e where target > 0),
m as (select *, sum(size) over (order by f, no, e, p, size desc rows unbounded preceding) upto from c where size > 0),
y as (select doc_id, size, no, p, sum(case when 100 * upto <= (select sum(size) from d) * {BUDGET_PERCENT} then size else 0 end) taken from m group by all)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(y.taken, 0) as bigint) taken
from q left join y on q.no = y.no and q.p = y.p and q.size = y.size and q.doc_id is not distinct from y.doc_id
"""
