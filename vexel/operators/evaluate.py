"""Recall, planted recall and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: mean over all queries of hits / k."""
    hits = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    each = queries.select("qid").join(hits, "qid", "left")
    return each.agg(F.try_divide(F.coalesce(F.sum("hits"), F.lit(0)).cast("double"), F.count(F.lit(1)) * F.lit(float(k))).alias("recall"))


def planted_recall(found: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: share of queries whose target_id was found."""
    hit = queries.join(found.select("qid", F.col("id").alias("target_id")).distinct().withColumn("hit", F.lit(1.0)), ["qid", "target_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("planted_recall"))


def nearest_rank(values: Column, percent: float) -> Column:
    """The element at ``round(percent / 100 * (n - 1))`` of the sorted values; 0 if there are none."""
    ordered = F.array_sort(values)
    place = F.round(F.lit(percent / 100) * (F.size(ordered) - 1)).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, place)).otherwise(F.lit(0.0))


def latency_report(times: DataFrame, column: str, *groups: str) -> DataFrame:
    """n, mean, p50, p90, p99, max and queries a second, for milliseconds. A report on a bounded number of queries (of a group)."""
    got = times.groupBy(*groups).agg(F.collect_list(column).alias("v"), F.avg(column).alias("mean"), F.max(column).alias("max"), F.count(column).alias("n"))
    return got.select(*groups, "n", "mean", *(nearest_rank(F.col("v"), p).alias(f"p{p}") for p in (50, 90, 99)), "max", F.try_divide(F.lit(1000.0), F.col("mean")).alias("per_second"))
