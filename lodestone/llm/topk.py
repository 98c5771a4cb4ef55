"""Exact top-k search by inner product: three-phase uniform threshold.

The dimensions are dealt to `slices` nodes; a node's score list for a query holds the inner products over its
own dimensions. Phase 1 gathers the best of each local list and adds up their complete scores: the k-th best
so far is a safe cutoff, for the final k-th best can't be lower. Phase 2 sends the cutoff to every block:
a vector that reaches it in total reaches cutoff / slices in one list at least, so the entries from there on
are collected. Phase 3 resolves the scores of the collected ones exactly and keeps what reaches the cutoff.
Queries and candidates whose lengths alone keep every list below that are left out of the products.

Queries and candidates meet as blocks of vectors, every query block with every candidate block, on a grid:
candidate blocks are dealt to its rows and go to every column, query blocks to its columns and every row. Rows
and columns are in proportion to both tables' sizes, so what is shuffled grows with the root of the number of
groups, not with the number.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null
ids. A query is compared with vectors of its own length. Of rows that repeat a query's id one is asked (the
smallest vector); as candidates repeated rows count each by itself. Ties go to the smaller id. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = "dim int, block long, ids binary, data binary"
LEAST = np.iinfo(np.int64).min // 4


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, q) rows as blocks of up to `rows` vectors of one length."""
    held: dict[int, list] = {}
    made = 0

    def block(dim: int) -> pa.RecordBatch:
        nonlocal made
        parts = held.pop(dim)
        made += 1
        number = (TaskContext.get().partitionId() << 32) + made
        ids, data = (np.concatenate([p[i] for p in parts]).astype("<i8").tobytes() for i in (0, 1))
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [number], "ids": [ids], "data": [data]})

    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes, flat = np.asarray(vectors.value_lengths()), np.asarray(vectors.flatten())
        begin = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for i in range(0, len(at), rows):
                some = at[i : i + rows]
                held.setdefault(dim, []).append((ids[some], flat[begin[some][:, None] + np.arange(dim)].ravel()))
                if sum(len(p[0]) for p in held[dim]) >= rows:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _arrays(row: dict, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids and vectors of the queries and of the candidates of a pair of blocks, and each node's dimensions."""
    q_ids, c_ids = (np.frombuffer(row[x], dtype="<i8") for x in ("q_ids", "ids"))
    q, c = (np.frombuffer(row[x], dtype="<i8").reshape(-1, row["dim"]) for x in ("q_data", "data"))
    return q_ids, c_ids, q, c, np.array_split(np.arange(row["dim"]), min(slices, row["dim"]))


def _reach(q: np.ndarray, c: np.ndarray, nodes: list[np.ndarray], safe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which queries and which candidates may have an entry of safe / nodes or more in some list: a product of
    vectors is no larger than that of their lengths."""
    size = [(np.sqrt((q[:, n].astype(np.float64) ** 2).sum(axis=1)), np.sqrt((c[:, n].astype(np.float64) ** 2).sum(axis=1))) for n in nodes]
    least, slack = safe.astype(np.float64), len(nodes) * (1 + 1e-9)
    asks = np.logical_or.reduce([slack * x * y.max(initial=0) + 1e-6 >= least for x, y in size])
    low = least[asks].min(initial=np.inf)
    holds = np.logical_or.reduce([slack * x[asks].max(initial=0) * y + 1e-6 >= low for x, y in size])
    return asks, holds


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, in any order; short rows are filled with LEAST."""
    if scores.shape[1] > k:
        return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
    return np.pad(scores, ((0, 0), (0, k - scores.shape[1])), constant_values=LEAST)


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, slices: int = 2, rows: int = 2048, query_rows: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k highest inner products among vectors of
    another id. Both have vec_id and embedding."""
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbers(df: DataFrame) -> DataFrame:
        made = df.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("q"))
        return made.filter("vec_id is not null and q is not null")

    asked = numbers(queries).groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = cut(asked.mapInArrow(lambda x: _blocks(x, query_rows), BLOCK), "queries").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "data": "q_data"})
    share = queries.count() / max(1, vectors.count())
    across = max(1, min(groups, round((groups * share) ** 0.5)))
    down = -(-groups // across)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    held = numbers(vectors).mapInArrow(lambda x: _blocks(x, rows), BLOCK).withColumn("down", F.pmod(F.xxhash64("block"), F.lit(down))).withColumn("across", every(across))
    dealt = (F.pmod(F.xxhash64("q_block"), F.lit(across)).alias("across"), every(down).alias("down"))
    cell = ["dim", "down", "across"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = list(top)
            return pa.RecordBatch.from_pydict({"q_block": pa.array([b for b in keys], pa.int64()), "best": pa.array([top[b].astype("<i8").tobytes() for b in keys], pa.binary())})

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, c_ids, q, c, nodes = _arrays(row, slices)
                lists, own = [_product(q[:, n], c[:, n]) for n in nodes], q_ids[:, None] == c_ids[None, :]
                total = np.where(own, LEAST, sum(lists))
                found = []
                for scores in lists:
                    n = min(k, scores.shape[1])
                    at = np.argpartition(np.where(own, LEAST, scores), scores.shape[1] - n, axis=1)[:, -n:]
                    found.append(at)
                at = np.sort(np.concatenate(found, axis=1), axis=1)
                score = np.take_along_axis(total, at, axis=1)
                score[:, 1:][at[:, 1:] == at[:, :-1]] = LEAST  # in two lists: counts once
                old = top.get(row["q_block"])
                top[row["q_block"]] = _best(score if old is None else np.concatenate([old, score], axis=1), k)
                if len(top) >= 256:
                    yield told()
                    top = {}
        yield told()

    def cutoff(key: tuple, table: pa.Table) -> pa.Table:
        best = [np.frombuffer(x, dtype="<i8").reshape(-1, k) for x in table.column("best").to_pylist()]
        safe = _best(np.concatenate(best, axis=1), k).min(axis=1)
        return pa.table({"q_block": pa.array([key[0].as_py()], pa.int64()), "safe": pa.array([safe.astype("<i8").tobytes()], pa.binary())})

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, c_ids, q, c, nodes = _arrays(row, slices)
                safe = np.frombuffer(row["safe"], dtype="<i8")
                asks, holds = _reach(q, c, nodes, safe)
                q_ids, q, safe, c_ids, c = q_ids[asks], q[asks], safe[asks][:, None], c_ids[holds], c[holds]
                lists, own = [_product(q[:, n], c[:, n]) for n in nodes], q_ids[:, None] == c_ids[None, :]
                q, c = np.nonzero(np.logical_or.reduce([len(lists) * x >= safe for x in lists]) & ~own)
                score = sum(x[q, c] for x in lists)
                keep = score >= safe[q, 0]
                q, c, score = q[keep], c[keep], score[keep]
                order = np.lexsort((c_ids[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < k  # no block holds more than k of a query's best
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[keep]]), pa.array(c_ids[c[keep]]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    # Spark sizes a table that explode repeats as if it were not repeated, and so might send all of its copies to every task.
    pairs = held.join(asked.select("*", *dealt).hint("merge"), cell)
    safe = pairs.mapInArrow(gather, "q_block long, best binary").groupBy("q_block").applyInArrow(cutoff, "q_block long, safe binary")
    told = asked.join(safe, "q_block").select("*", *dealt).hint("merge")
    found = held.join(told, cell).mapInArrow(collect, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_uniform_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) a
  JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
