"""Evaluation gates and operation of the service: alarms, queue, health."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import carried, ranks

HARD_GATES = [f"H{i}" for i in range(1, 8)]


def counted_gates(violations: DataFrame, gates: list[str] = HARD_GATES) -> DataFrame:
    """(gate, n) of all gates, also those without a violation (AGG-14)."""
    every = violations.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    return every.join(violations.groupBy("gate").agg(F.count("*").alias("n")), "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("n"))


def decided(metrics: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """metrics (gate, value, low, high, comparator, threshold) with `result` (AGG-26)."""
    value, limit = F.col("value"), F.col("threshold")
    met = F.when(F.col("comparator") == ">=", value >= limit - epsilon).otherwise(value <= limit + epsilon)
    crossed = F.coalesce((F.col("low") < limit) & (F.col("high") > limit), F.lit(False))
    return metrics.withColumn("result", F.when(value.isNull(), "not_measured").when(met & crossed, "uncertain").when(met, "pass").otherwise("fail"))


#: Targets of performance, each at most its limit: the step and percentile in milliseconds, or seconds of ingestion.
STEP_TARGETS = [
    ("retrieval_total_p50", "total", 0.5, 800), ("retrieval_total_p95", "total", 0.95, 1500), ("query_embedding_p95", "embedding", 0.95, 300),
    ("search_p95", "search", 0.95, 300), ("rerank_p95", "rerank", 0.95, 500),
]
LARGE_DOCUMENT, LARGE_CORPUS = ("ingestion_50_pages_seconds", 50, 300), ("ingestion_corpus_2000_pages_seconds", 2000, 14400)


def performance(steps: DataFrame, documents: DataFrame, corpus: DataFrame) -> DataFrame:
    """(target, limit, value, status) of all targets (AGG-13); what has no sample is not measured. steps: step, ms; documents: pages,
    seconds; corpus: one row, pages and seconds (null: not measured as a whole)."""
    spark = steps.sparkSession
    wanted = spark.createDataFrame([(t, s, float(p), float(x)) for t, s, p, x in STEP_TARGETS], "target string, step string, p double, limit double")
    ranked = ranks(steps, ["step"], "ms", sorted({p for _, _, p, _ in STEP_TARGETS})).select("step", "p", F.col("ms").cast("double").alias("value"))
    made = wanted.join(ranked, ["step", "p"], "left").select("target", "limit", "value")
    large, least, limit = LARGE_DOCUMENT
    made = made.unionByName(documents.filter(F.col("pages") >= least).agg(F.max("seconds").cast("double").alias("value")).select(F.lit(large).alias("target"), F.lit(float(limit)).alias("limit"), "value"))
    whole, least, limit = LARGE_CORPUS
    seconds = F.when(F.col("pages") >= least, F.col("seconds")).cast("double")
    made = made.unionByName(corpus.select(F.lit(whole).alias("target"), F.lit(float(limit)).alias("limit"), seconds.alias("value")))
    return made.withColumn("status", F.when(F.col("value").isNull(), "not_measured").when(F.col("value") <= F.col("limit"), "met").otherwise("not_met"))


def windowed(events: DataFrame, width: str, at: str = "ts") -> Column:
    return F.window(F.col(at).cast("timestamp"), width)


def rates(events: DataFrame, failed: Column, width: str, least: int) -> DataFrame:
    """(window_start, n, failed, rate) of tumbling windows with at least `least` samples (AGG-32, STM-1)."""
    made = events.groupBy(windowed(events, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return made.filter(F.col("n") >= least).select(F.col("w.start").alias("window_start"), "n", "failed", (F.col("failed") / F.col("n")).alias("rate"))


def edges(states: DataFrame, key: str, at: str, active: str) -> DataFrame:
    """Where a condition turns on or off; before the first state it is off (STM-3). A key's states, known ones, may be any number."""
    known = carried(states.filter(F.col(active).isNotNull()), [key], [at], last=[active])
    old = F.coalesce(f"prev_{active}", F.lit(False))
    return known.filter(old != F.col(active)).withColumn("change", F.when(F.col(active), "raised").otherwise("cleared")).drop(f"prev_{active}")


def cooled_down(alerts: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Alerts of which none follows a kept one of its key within `seconds` (STM-5). What is kept depends on what was
    kept before, so a key's alerts go through in order; only the last kept time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = object(), None
        for batch in batches:
            kept = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if k != known:
                    known, last = k, None
                kept.append(last is None or (t - last).total_seconds() >= seconds)
                last = t if kept[-1] else last
            yield batch.filter(pa.array(kept, pa.bool_()))

    ordered = alerts.filter(F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at)
    return ordered.mapInArrow(run, alerts.schema)
