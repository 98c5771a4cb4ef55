"""Vector code compression: product codes whose codebooks are trained by delta-maintained Lloyd rounds.

Vectors become whole numbers and are cut into equal parts, each with a codebook of its own. A round assigns
every part to the nearest entry of its codebook and moves the entries to the floors of their parts' means. The
assignments of the round before are stored, and the sums and counts of all entries are kept running: a task
adds up only the parts whose assignment has changed, plus at the new entry and minus at the old one, and only
these sums are shuffled, at most one for each entry and component of a task.

The vectors are dealt into buckets by row number once. Assignments, a few bytes a row, are written in the same
buckets, so that vectors and assignments meet without a shuffle in each round. A round is one table in the
shared folder: a lost executor costs its own tasks. Whole numbers make the result independent of partitions.

The driver has the codebooks and running sums: entries times dimensions, whatever the number of vectors.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; so are those with a
component whose whole number is beyond 2**24, for distances are 64-bit numbers. Of several lengths the most
frequent one that the number of parts divides takes part (of equals, the shorter). A null id is the largest and
is kept. Repeated ids and rows count each by itself; the first codebook takes equal ids by their vectors' bytes.
With fewer vectors than entries a codebook has fewer entries. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table
from .topk import whole_numbers

LIMIT = 1 << 24
ROUND = "row long, code binary, part int, entry int, place int, delta long, kind string"
CODED = "vec_id long, label string, code binary, error long"


def _bucketed(df: DataFrame, buckets: int, label: str, *folders: str) -> DataFrame:
    """df written to the shared folder in buckets of `row` and read back as a table that Spark knows to be so."""
    name = f"{label}_{uuid.uuid4().hex}"
    made = df.write.bucketBy(buckets, "row").option("path", f"{shared_dir(df.sparkSession).rstrip('/')}/{name}")
    (made.partitionBy(*folders) if folders else made).saveAsTable(name)
    return df.sparkSession.table(name)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column for each part: the nearest entry, of equals the first.

    vectors: whole numbers, rows by dimensions; books: parts by entries by width."""
    parts, _, width = books.shape
    most = max(np.abs(vectors).max(initial=0), np.abs(books).max(initial=0))
    kind = np.float64 if 4.0 * width * float(most) ** 2 < 2**53 else np.int64  # exact in both
    codes, errors = [], []
    for part in range(parts):
        x, book = vectors[:, part * width : (part + 1) * width].astype(kind), books[part].astype(kind)
        far = (book * book).sum(axis=1) - 2 * (x @ book.T)
        code = far.argmin(axis=1)
        codes.append(code)
        errors.append((far[np.arange(len(x)), code] + (x * x).sum(axis=1)).astype(np.int64))
    return np.stack(codes, axis=1), np.stack(errors, axis=1)


def _contributions(vectors: np.ndarray, old: np.ndarray, new: np.ndarray, sums: np.ndarray) -> None:
    """Adds to sums (parts, entries, width + 1; the count comes last) the changed parts of a batch. An old code of
    -1 has no entry to leave."""
    width = sums.shape[2] - 1
    for part in range(sums.shape[0]):
        at = np.flatnonzero(old[:, part] != new[:, part])
        x = np.append(vectors[at, part * width : (part + 1) * width].astype(np.int64), np.ones((len(at), 1), np.int64), axis=1)
        left = old[at, part] >= 0
        np.add.at(sums[part], new[at, part], x)
        np.subtract.at(sums[part], old[at[left], part], x[left])


def assignments(vectors: DataFrame, before: DataFrame | None, books: np.ndarray) -> DataFrame:
    """Rows of ROUND: of kind `code` the assignment of each row, of kind `delta` what a task's changes add to the
    running sums (place: the component, or the width for the count). before: assignments (row, old) or None."""
    (parts, entries, width), first = books.shape, before is None
    joined = vectors.select("row", "data")
    joined = joined.withColumn("old", F.lit(None).cast("binary")) if first else joined.join(before, "row")
    names = [x.split()[0] for x in ROUND.split(", ")]
    kinds = [pa.int64(), pa.binary(), *[pa.int32()] * 3, pa.int64(), pa.string()]

    def batch_of(n: int, **given) -> pa.RecordBatch:
        columns = [given[name] if name in given else pa.nulls(n, kind) for name, kind in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) if not isinstance(x, pa.Array) else x for x, kind in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("data"), "<i4")
            new = nearest(x, books)[0]
            old = np.full_like(new, -1) if first else _matrix(batch.column("old"), "<u2").astype(np.int64)
            _contributions(x, old, new, sums)
            code = [c.tobytes() for c in new.astype("<u2")]
            yield batch_of(len(x), row=batch.column("row"), code=code, kind=["code"] * len(x))
        part, entry, place = np.nonzero(sums)
        yield batch_of(len(part), part=part, entry=entry, place=place, delta=sums[part, entry, place], kind=["delta"] * len(part))

    return joined.mapInArrow(run, ROUND)


def codebooks(vectors: DataFrame, buckets: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after `rounds` rounds over vectors (row, vec_id, data), in `buckets` buckets."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "data", "row").limit(entries).select("data").collect()
    books = np.array([np.frombuffer(x.data, dtype="<i4") for x in first], dtype=np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2)
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
    before = None
    for _ in range(rounds):
        made = _bucketed(assignments(vectors, before, books), buckets, "round", "kind")
        before = made.filter("kind = 'code'").select("row", F.col("code").alias("old"))
        changes = made.filter("kind = 'delta'").groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")).collect()
        for x in changes:  # no more than the codebooks have numbers
            sums[x.part, x.entry, x.place] += x.delta
        counts = sums[:, :, -1:]
        books = np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)
    return books


def compressed(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (parts, entries, width) of vectors (vec_id, embedding, label), and a stored table of CODED: the code has one
    byte for each part up to 256 entries, else two; error is the sum of the parts' squared distances."""
    spark = vectors.sparkSession
    if not 0 < entries <= 1 << 16:
        raise ValueError("a codebook has 1 to 65,536 entries")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data = [np.asarray(x.values, dtype="<i4").tobytes() for x in batch.column("q")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(data)), pa.int64()), batch.column("vec_id"), batch.column("label"), pa.array(data, pa.binary())],
                ["row", "vec_id", "label", "data"],
            )
            row += len(data)

    q = whole_numbers(F.col("embedding"), scale)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), q.alias("q"))
    good = good.filter((F.size("q") % parts == 0) & F.forall("q", lambda v: F.abs(v) <= LIMIT))
    buckets = max(spark.sparkContext.defaultParallelism, vectors.count() >> 19)
    stored = good.mapInArrow(numbered, "row long, vec_id long, label string, data binary").repartition(buckets, "row")
    stored = _bucketed(stored, buckets, "vectors")
    lengths = stored.groupBy(F.octet_length("data").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return np.zeros((parts, 0, 0), dtype=np.int64), spark.createDataFrame([], CODED)
    stored = stored.filter(F.octet_length("data") == lengths["size"])
    books = codebooks(stored, buckets, parts, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = nearest(_matrix(batch.column("data"), "<i4"), books)
                code = [c.tobytes() for c in codes.astype(">u2" if entries > 256 else "u1")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.binary()), pa.array(errors.sum(axis=1))],
                    ["vec_id", "label", "code", "error"],
                )

    return books, cut(stored.select("vec_id", "label", "data").mapInArrow(run, CODED), "coded")


def with_total(df: DataFrame, key: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """df, a stored table, with the sum of value over the rows of equal key, nulls together. Keys that hold more than one in
    `share` rows are fewer than that, and meet their rows by broadcast; all others have small groups."""
    totals = cut(df.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("_rows")), "totals")
    least = df.count() // share
    same = df[key].eqNullSafe(F.col("_key"))
    heavy = F.broadcast(totals.filter(F.col("_rows") > least).select(F.col(key).alias("_key"), name))
    light = totals.filter(F.col("_rows") <= least).select(F.col(key).alias("_key"), name)
    hot, rest = df.join(heavy, same), df.join(heavy.select("_key"), same, "left_anti").join(light, same)
    return hot.unionByName(rest).drop("_key")


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, joined by commas, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, coded = compressed(table(spark, sf_dir, "embeddings"))
    return with_total(coded, "label", "error", "label_error").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")
    )


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """SQL for the query: every round in full, without running sums."""
    step = """
a{n} AS MATERIALIZED (
  SELECT vec_id, part, any_value(label) AS label, any_value(q) AS q, min(struct_pack(d := d, e := e)) AS best
  FROM (SELECT v.*, c.e, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM v JOIN c{n} c USING (part))
  GROUP BY vec_id, part
),"""
    move = """
m{n} AS MATERIALIZED (
  SELECT part, e, list(x ORDER BY place) AS q
  FROM (SELECT part, best.e AS e, place, CAST(floor(sum(q[place]) / count(*)) AS BIGINT) AS x
        FROM a{p}, (SELECT unnest(range(1, 1 + (SELECT max(len(q)) FROM v))) AS place)
        GROUP BY ALL)
  GROUP BY part, e
), c{n} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.q, c.q) AS q FROM c{p} c LEFT JOIN m{n} m USING (part, e)),"""
    head = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, label, part, q[CAST(part * len(q) // {parts} + 1 AS BIGINT) : CAST((part + 1) * len(q) // {parts} AS BIGINT)] AS q
  FROM whole, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, e, q FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM v) WHERE e < {entries}
),"""
    body = "".join(step.format(n=n) + move.format(n=n + 1, p=n) for n in range(rounds)) + step.format(n=rounds)
    return f"""{head}{body}
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY part) AS code,
         CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


OP12_SQL = _sql()
