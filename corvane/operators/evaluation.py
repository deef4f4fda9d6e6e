"""Measures of retrieval and of edges, and the gate that compares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision at 1, 3 and 5 (a hit among the first), mean reciprocal rank and recall at 5.

    ``results`` has ``query_id, id, rank`` with ranks from 1, ``gold`` has ``query_id, id``. Queries
    without results count as misses.
    """
    hit = results.join(gold.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    each = hit.groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.count_if((F.col("hit") == 1) & (F.col("rank") <= 5)).alias("found"))
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = wanted.join(each, "query_id", "left")
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return all_.agg(
        F.count(F.lit(1)).alias("n_queries"), at(1).alias("p_at_1"), at(3).alias("p_at_3"), at(5).alias("p_at_5"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall_at_5"),
    )


def edge_quality(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall and the share of targets with exactly the gold edges."""
    f, g = found.select("target_id", "source_id").distinct().withColumn("f", F.lit(1)), gold.select("target_id", "source_id").distinct().withColumn("g", F.lit(1))
    both = f.join(g, ["target_id", "source_id"], "full_outer")
    per = both.groupBy("target_id").agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return per.agg(
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("precision"),
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("recall"),
        F.avg(F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1.0).otherwise(0.0)).alias("exact"),
    )


def gate(metrics: DataFrame, baseline: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``metric, value, base, verdict``: whether each metric is worse than its baseline, by its direction (1 or -1)."""
    worse = (F.col("value") - F.col("base")) * F.col("direction") < -eps
    return metrics.join(baseline, "metric").select("metric", "value", "base", F.when(worse, "fail").otherwise("pass").alias("verdict"))


def paired(a: DataFrame, b: DataFrame, worst: int = 99) -> DataFrame:
    """``better, worse, same`` of the ranks of b against those of a, query by query; no rank counts as ``worst``."""
    x = a.select("query_id", F.coalesce("rank", F.lit(worst)).alias("x"))
    y = b.select("query_id", F.coalesce("rank", F.lit(worst)).alias("y"))
    both = x.join(y, "query_id", "full_outer").select(F.coalesce("x", F.lit(worst)).alias("x"), F.coalesce("y", F.lit(worst)).alias("y"))
    return both.agg(F.count_if(F.expr("y < x")).alias("better"), F.count_if(F.expr("y > x")).alias("worse"), F.count_if(F.expr("y = x")).alias("same"))
