"""Review of normalized values: which to look at, in which order, and what becomes of the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions.text import trim
from curatrix.operators.normalize import UNKNOWN, flagged

ACTIONS = ("keep_normalized", "replace_normalized", "set_unknown", "defer")


def review_items(fields: DataFrame) -> DataFrame:
    """Flagged slots, and unknown ones for recovery, ranked inside their record by priority (recovery: 0), then slot. A record has as
    many rows as slots, so the window is small."""
    flag = flagged()
    out = fields.filter(flag | (F.col("status") == UNKNOWN)).withColumn("sort_priority", F.when(flag, F.col("review_priority")).otherwise(0))
    out = out.withColumn("reasons", F.when(flag, F.col("reasons")).otherwise(F.array_append("reasons", F.lit(dims.RECOVERY)))).withColumn("status", F.lit("review_required"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("sort_priority"), "slot")))


def review_limit(items: DataFrame, n: int, line: str) -> DataFrame:
    """The first n items in order of input line and rank: a top-n, no global window. Negative n gives none."""
    return items.orderBy(line, "rank").limit(max(0, n))


def mock_review(items: DataFrame) -> DataFrame:
    return items.withColumns({"action": F.lit("keep_normalized"), "reviewed_value": F.col("value"), "confidence": F.lit("medium"), "needs_manual_followup": F.lit(False), "reason": F.lit("mock review")})


def parse_payload(items: DataFrame) -> DataFrame:
    """items with payload struct (action, reviewed_value, confidence, archetype, slot, needs_manual_followup, reason) -> decision columns.
    A payload for another archetype or slot defers, whatever it says."""
    p = lambda f: F.col(f"payload.{f}")
    word = F.coalesce(F.when(p("action") != "", trim(p("action"))), F.lit("defer"))
    action = F.when(word.isin(*ACTIONS), word).otherwise("defer")
    now, said = F.coalesce(F.when(F.col("value") != "", F.col("value")), F.lit("unknown")), F.coalesce(trim(p("reviewed_value")), F.lit(""))
    value = F.when(action == "keep_normalized", now).when(action == "set_unknown", "unknown").when(said != "", said).when(action == "defer", now).otherwise("unknown")
    level = F.lower(trim(F.coalesce(p("confidence"), F.lit("low"))))
    broken = (F.coalesce(p("archetype"), F.col("archetype")) != F.col("archetype")) | (F.coalesce(p("slot"), F.col("slot")) != F.col("slot"))
    broken = F.coalesce(broken, F.lit(False))
    final = F.when(broken, "defer").otherwise(action)
    return items.withColumns(
        {
            "action": final,
            "reviewed_value": F.when(broken, now).otherwise(value),
            "confidence": F.when(broken | ~level.isin("high", "medium", "low"), "low").otherwise(level),
            "needs_manual_followup": F.coalesce(p("needs_manual_followup"), final == "defer"),
            "reason": F.coalesce(F.when(trim(p("reason")) != "", trim(p("reason"))), F.lit("no reason provided")),
        }
    )


def _policy(action: Column, level: Column, reasons: Column) -> tuple[Column, Column]:
    recovery, severe = F.array_contains(reasons, dims.RECOVERY), F.arrays_overlap(reasons, F.array(*map(F.lit, dims.SEVERE)))
    sure = level.isin("high", "medium")
    replace, unknown = action == "replace_normalized", action == "set_unknown"
    ok_unknown = (level == "high") | severe
    applied = F.when(replace, recovery | sure).when(unknown, ok_unknown).otherwise(False)
    why = F.when(replace & recovery, "accepted_replace_unknown_recovery").when(replace & sure, "accepted_replace").when(replace, "rejected_low_confidence_replace")
    return applied, why.when(unknown & ok_unknown, "accepted_set_unknown").when(unknown, "rejected_low_confidence_set_unknown").otherwise("not_applicable")


def apply_policy(decisions: DataFrame) -> DataFrame:
    applied, why = _policy(F.col("action"), F.col("confidence"), F.col("reasons"))
    return decisions.withColumn("applied", applied).withColumn("application_reason", why)


def apply_review(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """fields plus effective_value and review_status: not_needed where no slot of the record was looked at, else completed. decisions:
    one row a record and slot; failed calls come as deferred ones."""
    d = decisions.select("record_id", "slot", "applied", "reviewed_value", F.lit(True).alias("_seen"))
    d = d.hint("merge")  # as many as there are slots to look at: never one table at the driver, however small the files say it is
    out = fields.join(d, ["record_id", "slot"], "left")
    seen = F.max("_seen").over(Window.partitionBy("record_id"))
    out = out.withColumn("review_status", F.when(seen.isNull(), "not_needed").otherwise("completed"))
    return out.withColumn("effective_value", F.when(F.col("applied"), F.col("reviewed_value")).otherwise(F.col("value"))).drop("_seen", "applied", "reviewed_value")


def review_summary(decisions: DataFrame) -> DataFrame:
    """(kind, k, n): decisions by action, by reason and by whether they were applied."""
    keys = F.concat(
        F.array(F.struct(F.lit("action").alias("kind"), F.col("action").alias("k")), F.struct(F.lit("applied").alias("kind"), F.col("applied").cast("string").alias("k"))),
        F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("k"))),
    )
    return decisions.select(F.explode(keys).alias("x")).groupBy("x.kind", "x.k").agg(F.count("*").alias("n"))


def coerce_input(rows: DataFrame) -> DataFrame:
    """A typed sample from a loose row: id from sample_id, else record_id; missing texts empty; missing or odd class_id 0."""
    return rows.select(
        F.coalesce(F.when(F.col("sample_id") != "", F.col("sample_id")), F.col("record_id"), F.lit("")).alias("sample_id"),
        F.coalesce("class_name", F.lit("")).alias("class_name"),
        F.coalesce(F.try_cast("class_id", "int") if hasattr(F, "try_cast") else F.expr("try_cast(class_id as int)"), F.lit(0)).alias("class_id"),
    )
