"""Evaluation of retrieval: minimums, recomputation and budgets; observation.py has gates and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many cases of which types a run needs.
TYPE_MINIMUMS = [
    ("answerable", ["direct", "multi_chunk"], 20),
    ("unanswerable", ["unanswerable"], 5),
    ("historical", ["historical"], 3),
    ("conflict", ["conflict"], 2),
    ("distractor", ["distractor"], 3),
    ("access", ["permission", "filter"], 3),
]


def minimums(cases: DataFrame, rules: Sequence[tuple[str, Sequence[str], int]] = TYPE_MINIMUMS) -> DataFrame:
    """(rule, least, n, met): how many cases (type) each rule's types have; a rule without any counts none (AGG-15)."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(r, list(t), n) for r, t, n in rules], "rule string, types array<string>, least int")
    n = cases.groupBy("type").agg(F.count("*").alias("n"))
    made = wanted.select("rule", "least", F.explode("types").alias("type")).join(n, "type", "left").groupBy("rule", "least")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("met", F.col("n") >= F.col("least"))


def mismatches(stored: DataFrame, recomputed: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """(metric, stored, recomputed) where a report's numbers differ from those computed anew, or one is missing
    (AGG-28). Both: metric, value."""
    both = stored.select("metric", F.col("value").alias("stored"), F.lit(True).alias("x")).join(recomputed.select("metric", F.col("value").alias("recomputed"), F.lit(True).alias("y")), "metric", "full")
    same = F.col("x").isNotNull() & F.col("y").isNotNull()
    near = F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= epsilon, F.col("stored").isNull() & F.col("recomputed").isNull())
    return both.filter(~(same & near)).select("metric", "stored", "recomputed")


def capped_prefix(items: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """Each group's items up to the first that would overflow the budget (EVL-6)."""
    run = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("total", run).filter(F.col("total") <= most)
