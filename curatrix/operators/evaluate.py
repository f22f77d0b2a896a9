"""Aggregation of evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_top_k(scores: Column, target: Column, k: int) -> Column:
    """Fewer than k scores are strictly above the target's."""
    own = F.element_at(scores, (target + 1).cast("int"))
    return F.size(F.filter(scores, lambda s: s > own)) < k


def topk_accuracy(df: DataFrame, scores: Column, target: Column, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    return df.agg(*[F.round(100 * F.avg(in_top_k(scores, target, k).cast("double")), 4).alias(f"top{k}") for k in ks])


def weighted_mean(df: DataFrame, keys: list[str], value: Column, n: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(value * n) / F.sum(n), 4).alias("mean"), F.sum(n).alias("n"))


def best_epoch(log: DataFrame, keys: list[str]) -> DataFrame:
    """log (keys, epoch, acc1, acc5): best acc1, the earliest on ties, with that epoch's acc5; nothing above 0 gives zeros."""
    best = F.max_by(F.struct("acc1", "acc5", "epoch"), F.struct("acc1", (-F.col("epoch")).alias("e")))
    out = log.groupBy(*keys).agg(best.alias("b"))
    some = F.col("b.acc1") > 0
    return out.select(*keys, F.when(some, F.col("b.acc1")).otherwise(0.0).alias("best_acc1"), F.when(some, F.col("b.acc5")).otherwise(0.0).alias("best_acc5"), F.when(some, F.col("b.epoch")).alias("best_epoch"))


def validated(epoch: Column, epochs: Column) -> Column:
    """Whether an epoch is validated: every hundredth part of the run, and the last."""
    step = F.greatest(F.floor(epochs / 100), F.lit(1))
    return (epoch % step == 0) | (epoch == epochs - 1)


def running_best(log: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("best_acc1", F.greatest(F.lit(0.0), F.max("acc1").over(w)))


def repeat_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the runs' best accuracies."""
    return runs.groupBy(*keys).agg(F.round(F.avg("best_acc1"), 2).alias("mean_acc1"), F.round(F.stddev_pop("best_acc1"), 2).alias("std_acc1"), F.round(F.avg("best_acc5"), 2).alias("mean_acc5"), F.count("*").alias("runs"))


def seed_protocol(evaluations: DataFrame) -> DataFrame:
    """evaluations (seed, written_at, eval_id, best array<double>): newest of each seed, its best repeat, then one row over seeds."""
    newest = evaluations.groupBy("seed").agg(F.max_by("best", F.struct("written_at", "eval_id")).alias("best"))
    per = newest.select("seed", F.array_max("best").alias("best"))
    return per.agg(F.count("*").alias("seeds"), F.round(F.avg("best"), 4).alias("mean"), F.round(F.coalesce(F.when(F.count("*") > 1, F.stddev_pop("best")), F.lit(0.0)), 4).alias("std"), F.round(F.min("best"), 4).alias("low"), F.round(F.max("best"), 4).alias("high"))


def missing_seeds(seeds: DataFrame, evaluations: DataFrame) -> DataFrame:
    return seeds.join(evaluations.select("seed").distinct(), "seed", "left_anti")


def distilled_summary(images: DataFrame) -> DataFrame:
    return images.groupBy("class_name_raw").agg(F.count("*").alias("images"))


def class_count_check(images: DataFrame, declared: int) -> DataFrame:
    return images.agg(F.count_distinct("class_name_raw").alias("found")).select("found", F.lit(declared).alias("declared"), (F.col("found") != declared).alias("mismatch"))
