"""What the corpus operators share: table access, cutting lineage, Arrow columns as bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves if all
    run on one machine, and nothing on a cluster."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with: it learns of them when the driver
    collects garbage, which an idle driver may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read back: later stages survive lost executors
    without redoing what lies before. The folder belongs to the run and goes with it. free: after a large
    shuffle, its files go as soon as they are not needed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns, whatever their names, don't matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def by_bytes(batches: Iterator[pa.RecordBatch], columns: str | tuple[str, ...], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that what the columns of one hold comes to about `limit` bytes; a longer text is a batch by itself."""
    names = (columns,) if isinstance(columns, str) else columns
    for batch in batches:
        sizes = np.sum([pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in names], axis=0).tolist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
