"""Connected components of a graph given as an edge table, by alternating stars.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest of them
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), until nothing changes. Minima are
aggregated before the shuffle and joined back at the node and one of `SALT` parts of its neighbours, so that a
node with very many edges is no task's alone. Rounds end as soon as all edges are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars of its own components: dense groups shrink before anything is shuffled."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        n = batch.num_rows
        up = list(range(len(nodes)))
        for a, b in zip(place[:n].tolist(), place[n:].tolist(), strict=True):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[max(a, b)] = min(a, b)
        for i in range(len(up)):
            up[i] = up[up[i]]  # a node's parent is smaller, so it is a root by now
        root = nodes[np.array(up, dtype=np.int64)] if n else nodes
        far = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["u", "v"])


def thinned(edges: DataFrame, together: int = 16, rows: int = 1 << 20) -> DataFrame:
    """Edges (u, v) with the same components: stars of what `together` tasks wrote, up to `rows` at a time, so
    that a dense group spread over many tasks comes with few edges for each of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= rows:
                yield from _forest(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))
                held, n = [], 0
        if n:
            yield from _forest(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))

    pair = cut(edges.toDF("u", "v").mapInArrow(run, "u long, v long"), "edges")
    return cut(pair.coalesce(max(1, pair.rdd.getNumPartitions() // together)).mapInArrow(run, "u long, v long"), "thin-edges")


SALT = 8


def _with_least(edges: DataFrame, own: bool) -> tuple[DataFrame, DataFrame]:
    """(u, m) of the least neighbour of each u, or u itself if `own` and that is less; and edges (u, v) with m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", (F.least("u", "m") if own else F.col("m")).alias("m"))
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    # Merged: Spark sizes exploded rows as those they come from, and might broadcast SALT times what it takes them for.
    return least, edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALT))).join(parts.hint("merge"), ["u", "part"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, own=True)[1].filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least, moved = _with_least(edges, own=False)
    moved = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _open(pair: DataFrame) -> bool:
    """Whether the edges are anything but stars: a node hangs on two others, or on one that hangs itself."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = pair.select("u", one.alias("up"), zero.alias("down")).unionByName(pair.select(F.col("v").alias("u"), zero.alias("up"), one.alias("down")))
    ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return bool(ends.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count())


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): for every node of an edge that isn't the smallest of its component, the smallest one.

    edges: long columns u and v, in any order, repeats and loops allowed, no nulls."""
    pair = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
    pair = pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pair = cut(pair.mapInArrow(_forest, "u long, v long"), "edges")
    while True:
        pair = cut(_small(_large(pair)), "edges")
        if not _open(pair):
            return pair.select(F.col("u").alias("node"), F.col("v").alias("root"))
