"""Retrieval: vector and lexical top-k, rank fusion, reranking, capped selection, neighbour merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import cosine, rrf, six, tokens


def ranked(df: DataFrame, k: int, order: Sequence[Column], rank: str) -> DataFrame:
    """The first k rows, numbered: a distributed top-k first, so that only k rows are numbered in one place."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def vector_top_k(vectors: DataFrame, probe: Sequence[float], k: int, key: str = "chunk_id") -> DataFrame:
    """(key, vector_score, vector_rank) by cosine similarity; ties by key (SRT-1, WIN-1)."""
    query = F.array(*[F.lit(float(x)) for x in probe])
    scored = vectors.filter(F.size("embedding") == len(probe)).select(key, six(cosine("embedding", query)).alias("vector_score"))
    return ranked(scored, k, [F.desc("vector_score"), F.col(key)], "vector_rank")


def lexical_top_k(texts: DataFrame, terms: Sequence[str], k: int, key: str = "chunk_id") -> DataFrame:
    """(key, lexical_score, lexical_terms, lexical_rank): the share of the query's terms that the text has (RET-1)."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))]).cast("array<string>")
    hit = F.array_sort(F.array_intersect(wanted, tokens("text")))
    scored = texts.select(key, hit.alias("lexical_terms")).filter(F.size("lexical_terms") > 0)
    scored = scored.select(key, six(F.size("lexical_terms") / F.lit(max(1, len(set(terms))))).alias("lexical_score"), "lexical_terms")
    return ranked(scored, k, [F.desc("lexical_score"), F.col(key)], "lexical_rank")


def postings(texts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(token, key), once each: an inverted index. Written once, partitioned or sorted by token, it answers every
    question from the rows of its terms; texts are not tokenised again."""
    return texts.select(F.explode(F.array_distinct(tokens("text"))).alias("token"), key)


def lexical_from_postings(index: DataFrame, terms: Sequence[str], k: int, key: str = "chunk_id") -> DataFrame:
    """What lexical_top_k gives, of an index; the filter on terms reaches its scan."""
    wanted = sorted(set(terms))
    hits = index.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("lexical_terms"))
    scored = hits.select(key, six(F.size("lexical_terms") / F.lit(max(1, len(wanted)))).alias("lexical_score"), "lexical_terms")
    return ranked(scored, k, [F.desc("lexical_score"), F.col(key)], "lexical_rank")


def fused(vector: DataFrame, lexical: DataFrame, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Both lists as one, by reciprocal ranks, then the better rank, then the key (JOIN-2, MTH-2, WIN-5)."""
    both = vector.join(lexical, key, "full")
    both = both.withColumn("fused_score", rrf("vector_rank", "lexical_rank", k=k)).withColumn("best_rank", F.least("vector_rank", "lexical_rank"))
    order = [F.desc("fused_score"), F.col("best_rank"), F.col(key)]
    return both.withColumn("fused_rank", F.row_number().over(Window.orderBy(*order)))  # of 2 k rows at most


def rerank_none(candidates: DataFrame, n: int) -> DataFrame:
    """The fused order, with scores as shares of the highest (SRT-5)."""
    top = F.max("fused_score").over(Window.partitionBy(F.lit(1)))
    return candidates.withColumn("score", six(F.col("fused_score") / top)).filter(F.col("fused_rank") <= n)


def capped(df: DataFrame, group: str, each: int, k: int, order: Sequence[Column], least: float | None = None) -> DataFrame:
    """At most `each` rows of a group, then the first k of all (WIN-6)."""
    if least is not None:
        df = df.filter(F.col("score") >= least)
    mine = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return ranked(df.withColumn("_n", mine).filter(F.col("_n") <= each).drop("_n"), k, order, "rank")


def islands(df: DataFrame, group: Sequence[str], at: str) -> DataFrame:
    """df with `island`: the first `at` of each run of consecutive ones within a group (WIN-7). Rows of a group are sorted once."""
    order = Window.partitionBy(*group).orderBy(at)
    begins = F.coalesce(F.col(at) - F.lag(at).over(order) != 1, F.lit(True))
    return df.withColumn("_begins", F.when(begins, F.col(at))).withColumn("island", F.last("_begins", True).over(order)).drop("_begins")


def runs(df: DataFrame, group: Sequence[str], at: str) -> DataFrame:
    """(group, island, last, parts): each run of consecutive `at`, however often each occurs: its first, its last and how many
    they are (WIN-7). Repeats and runs are told from neighbours in one order, so a task sorts its rows once and keeps no others."""
    order = Window.partitionBy(*group).orderBy(at)
    once = df.select(*group, at, F.lag(at).over(order).alias("_before"), F.row_number().over(order).alias("_nth"))
    once = once.filter((F.col("_nth") == 1) | ~F.col(at).eqNullSafe(F.col("_before"))).drop("_nth")
    made = once.select(*group, at, "_before", F.lead(at).over(order).alias("_after"))
    made = made.withColumn("_begins", F.when(F.coalesce(F.col(at) - F.col("_before") != 1, F.lit(True)), F.col(at))).withColumn("island", F.last("_begins", True).over(order))
    ends = made.filter(F.coalesce(F.col("_after") - F.col(at) != 1, F.lit(True)))
    return ends.select(*group, "island", F.col(at).alias("last"), F.coalesce((F.col(at) - F.col("island") + 1).cast("long"), F.lit(1).cast("long")).alias("parts"))
