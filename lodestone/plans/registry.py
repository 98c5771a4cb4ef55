"""All queries on the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import deciding, documents, evaluating, evidence, governing, operating, retrieval, reviewing, structuring

ALL = {**retrieval.QUERIES, **governing.QUERIES, **operating.QUERIES, **documents.QUERIES, **deciding.QUERIES, **evidence.QUERIES, **evaluating.QUERIES, **reviewing.QUERIES, **structuring.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
