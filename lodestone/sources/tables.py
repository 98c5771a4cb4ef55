"""Readers and writers: tables, JSON lines with error capture, idempotent and insert-if-absent writes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1 on. A file may be split: each split numbers its own lines, and what comes
    before it is the sum of the splits before, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            own = []
            for split in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                at, n = split, n + 1 if split == at else 1
                own.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "nth"])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    known = lines.mapInArrow(run, "file string, start long, value string, nth long")
    sizes = known.groupBy("file", "start").agg(F.max("nth").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return known.join(shifts, ["file", "start"]).select("file", (F.col("nth") + F.col("before")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """file, line, columns of schema, and `problem`: the line as it stands where it is no object of that schema. Blank
    lines count as lines, and have no row (SRC-4)."""
    whole = StructType([*schema.fields, StructField("problem", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "problem"}
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select("file", "line", F.from_json("value", whole, options).alias("j")).select("file", "line", "j.*")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file, to tell whether inputs changed (SRC-5)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new, gone or different."""
    both = before.withColumnRenamed("sha256", "old").join(after.withColumnRenamed("sha256", "new"), "path", "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrites only the partitions that df has rows of; writing again changes nothing (SRC-8, STM-7)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def absent(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """The rows of new whose keys are not stored yet, one for each key; null keys are equal (SRC-9)."""
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return new.dropDuplicates(list(keys)).join(old, condition, "left_anti")


def validated_files(files: DataFrame, limit: int = 50 * 1024 * 1024) -> DataFrame:
    """(path, problem) of binaryFile rows with the expected sha256: the first rule that fails (SRC-3)."""
    head = F.substring(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), 1, 1024)
    problem = (
        F.when(F.length("content") == 0, "empty")
        .when(F.length("content") > limit, "too_large")
        .when(F.instr(head, "%PDF-") == 0, "not_a_pdf")
        .when(F.sha2("content", 256) != F.lower("expected_sha256"), "checksum")
        .when(F.instr(F.decode("content", "ISO-8859-1"), "/Encrypt") > 0, "encrypted")
    )
    return files.select("path", problem.alias("problem"))


def event_lines(events: DataFrame) -> DataFrame:
    """Each row as one JSON line (SRC-11, JSN-2)."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def add_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Adds a batch of events as JSON lines to an event log at path, under the batch's number: a batch that comes again
    takes its own place, so it adds nothing (SRC-11)."""
    event_lines(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(path)


def event_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of events into an event log; start() begins it."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder of spark.checkpoint.dir. Where the session names none, a temporary folder serves if
    all run on one machine, and nothing on a cluster."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return f"{context.getCheckpointDir().rstrip('/')}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, to end its lineage."""
    path = shared_path(df.sparkSession, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written to the shared folder in buckets of `key` and read back as a table that Spark knows to be so: what is joined or
    grouped by it is not shuffled again. The shuffle files of making it go as soon as Spark's cleaner comes to them."""
    name = f"by_{key}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", shared_path(df.sparkSession, name)).saveAsTable(name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.table(name)


#: At most so many bytes, as counted by `few`, go to every task.
FEW = 24 << 20


def few(df: DataFrame) -> DataFrame:
    """df written and measured: where it is small it goes to every task, so that what it meets isn't shuffled for it. Columns
    are strings, or of 8 bytes at most."""
    made = cut(df)
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind == "string" else F.lit(8) for c, kind in made.dtypes]
    size = sizes[0].cast("long")
    for x in sizes[1:]:
        size = size + x
    return F.broadcast(made) if (made.agg(F.sum(size)).first()[0] or 0) <= FEW else made
