"""Retrieval for many questions at once: block products for vectors, fusion, rerank, caps and neighbours by question.

Questions and candidates meet as blocks of vectors on a grid: candidate blocks are dealt to its rows and go to every
column, question blocks to its columns and every row. Rows and columns are in proportion to both tables, so what is
shuffled grows with the root of the number of tasks. A task passes on k rows for each question, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import rrf, six
from lodestone.operators.index import best
from lodestone.operators.search import islands
from lodestone.sources.tables import cut

BLOCK = "dim int, ids binary, data binary"


def _blocks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, embedding) as blocks of up to `rows` vectors of one length, at length 1; vectors that are null, empty or hold a
    null or a number that is not finite are left out, and one of length 0 stays as it is."""

    def block(dim: int, parts: list) -> pa.RecordBatch:
        x = np.concatenate([p[1] for p in parts])
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(size == 0, 1.0, size)
        ids = np.concatenate([p[0] for p in parts]).astype("<i8")
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "data": [x.astype("<f8").tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes, flat = np.asarray(vectors.value_lengths()), np.asarray(vectors.flatten())
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for i in range(0, len(at), rows):
                    some = at[i : i + rows]
                    held.setdefault(dim, []).append((ids[some], flat[begin[some][:, None] + np.arange(dim)].reshape(-1, dim)))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    x = F.transform("embedding", lambda v: v.cast("double"))
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("x")).mapInArrow(run, BLOCK)


def vector_many(vectors: DataFrame, questions: DataFrame, k: int = 50, key: str = "chunk_id", rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """(query_id, key, vector_score, vector_rank): for each question (query_id, embedding) the k vectors (key, embedding) of
    the highest cosine similarity to six decimals; ties by key (SRT-1, WIN-1)."""
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = questions.count() / max(1, vectors.count())
    across = max(1, min(groups, round((groups * share) ** 0.5)))
    down = -(-groups // across)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")

    held = _blocks(vectors, key, rows).withColumn("down", dealt(down)).withColumn("across", every(across))
    asks = _blocks(questions, "query_id", query_rows).withColumn("across", dealt(across)).withColumn("down", every(down))
    asks = asks.withColumnsRenamed({"ids": "q_ids", "data": "q_data"})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, ids = (np.frombuffer(row[x], dtype="<i8") for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(row[x], dtype="<f8").reshape(-1, row["dim"]) for x in ("q_data", "data"))
                score = np.floor(q @ c.T * 1e6 + 0.5) / 1e6
                n = min(k, len(ids))
                order = np.argsort(ids, kind="stable")
                at = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :n]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, n)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(score, at, axis=1).ravel())], ["query_id", key, "vector_score"]
                )

    found = held.join(asks, ["dim", "down", "across"]).mapInArrow(nearest, f"query_id long, {key} long, vector_score double")
    return best(found, k, "vector_score", "vector_rank", key)


def fused_many(vector: DataFrame, lexical: DataFrame, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Both lists of each question as one, by reciprocal ranks, then the better rank, then the key (JOIN-2, WIN-5)."""
    both = vector.join(lexical, ["query_id", key], "full")
    both = both.withColumn("fused_score", rrf("vector_rank", "lexical_rank", k=k)).withColumn("best_rank", F.least("vector_rank", "lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "best_rank", key)
    return both.withColumn("fused_rank", F.row_number().over(order))


def rerank_none_many(candidates: DataFrame, n: int) -> DataFrame:
    """The fused order of each question, with scores as shares of its highest (SRT-5)."""
    top = F.max("fused_score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("score", six(F.col("fused_score") / top)).filter(F.col("fused_rank") <= n)


def composed(candidates: DataFrame, group: str, at: str, each: int, k: int, least: float) -> DataFrame:
    """Of each question's candidates at most `each` of a group and k in all, with `island`, the first of a run of neighbours
    (RET-3, WIN-6, WIN-7)."""
    own = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "fused_rank")
    kept = candidates.filter(F.col("score") >= least).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= each)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return islands(kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("nth"), ["query_id", group], at)


def placed_many(near: DataFrame, lexical: DataFrame, key: str = "chunk_id", no_rank: int = 1_000_000) -> DataFrame:
    """Candidates of both retrievers in the order of their better rank, then the key (RET-2, SRT-3)."""
    both = near.join(lexical, ["query_id", key], "full")
    first = F.least(F.coalesce("vector_rank", F.lit(no_rank)), F.coalesce("lexical_rank", F.lit(no_rank)))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(first, key)))


def searched(chunks: DataFrame, vectors: DataFrame, index, allowed: DataFrame, probes: DataFrame, questions: DataFrame, k: int = 50) -> DataFrame:
    """Candidates of both retrievers for many questions among the chunks of allowed versions (RET-2). chunks: chunk_id, version;
    index: of their texts; allowed: version and what else is wanted. What may not be read takes no rank: the
    allowed set is cut once, and both searches see no more than its chunks."""
    from lodestone.operators.index import by_shared_words

    allowed = cut(allowed)
    own = cut(chunks.select("chunk_id", "version").join(allowed.select("version").distinct(), "version", "left_semi"))
    near = vector_many(vectors.join(own, "chunk_id", "left_semi"), probes, k)
    lexical = by_shared_words(index, questions, k, own.select(F.col("chunk_id").alias("key"))).withColumnRenamed("key", "chunk_id")
    return placed_many(near, lexical).join(own, "chunk_id").join(allowed, "version")
