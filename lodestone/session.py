"""The session that the library expects: UTC, adaptive execution, no limits on what a plan may do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
