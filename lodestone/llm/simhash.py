"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in 3 bits at most differ
in 1 bit at most in one of the segments, so each fingerprint enumerates the Hamming ball of radius 1 around
its segments, fetches the table's entries there and verifies the complete distance. As links are symmetric,
the ball needs only the segment itself and those with one of its set bits cleared.

Fingerprints are made distinct first, so a group of copies is one entry. A segment value shared by more than
`dense` distinct fingerprints is searched by a finer index: the segment and, with radius 1 again, a half of
the other segment. Nothing is capped.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and is linked like any
other. Repeated rows link to each other. A null doc_id takes part, but is no component's smallest id unless
the component has no other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, cut, table, texts
from .components import connected_components

RADIUS = 3


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the `width`-word shingles, repeats included; as a signed 64-bit number."""
    words = text.lower().split()  # of bytes: both ASCII only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
        begin = np.concatenate(([0], ends[: n - width])).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(begin, (ends[width - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[start : start + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs' columns but `text`, and fp long, for every row of docs (text and any other columns)."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            made = [fingerprint(x, width) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made, pa.int64())], [*others, "fp"])

    return docs.mapInArrow(run, docs.drop("text").schema.add("fp", "long"))


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, seg, key, rest): both segments, each with the bits that it leaves out."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    both = F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("key"), low.alias("rest")),
        F.struct(F.lit(1).alias("seg"), low.alias("key"), high.alias("rest")),
    )
    return fps.select("fp", F.explode(both).alias("s")).select("fp", "s.*")


def _ball(df: DataFrame, key: str, bits: int, both_ways: bool) -> DataFrame:
    """df with `key` replaced by each value of its ball of radius 1; `flip`: the bit changed, or -1. Unless
    both_ways, bits are only cleared."""
    at = df.withColumn("flip", F.explode(F.array(*[F.lit(i) for i in range(-1, bits)])))
    one = F.expr("shiftleft(1L, greatest(flip, 0))")
    if not both_ways:
        at = at.filter((F.col("flip") < 0) | (F.col(key).bitwiseAND(one) != 0))
    return at.withColumn(key, F.when(F.col("flip") < 0, F.col(key)).otherwise(F.col(key).bitwiseXOR(one)))


def _halves(df: DataFrame) -> DataFrame:
    """df for each half of `rest`: (half, sub)."""
    both = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("rest", 16).alias("sub")),
        F.struct(F.lit(1).alias("half"), F.col("rest").bitwiseAND(0xFFFF).alias("sub")),
    )
    return df.withColumn("h", F.explode(both)).select(*df.columns, "h.half", "h.sub")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(fps: DataFrame, dense: int = 256) -> DataFrame:
    """(fp, other): every pair of distinct fingerprints within RADIUS bits, perhaps repeated. fps: distinct `fp`.

    Spark sizes exploded rows as those they come from, and would broadcast a ball that is many times larger; so balls are merged."""
    entries = _segments(fps)
    full = entries.groupBy("seg", "key").count().filter(F.col("count") > dense).select("seg", "key", F.lit(True).alias("full"))
    entries = entries.join(full, ["seg", "key"], "left")
    stored = entries.select("seg", "key", "full", "rest", F.col("fp").alias("other"))
    probes = _ball(_segments(fps), "key", 32, both_ways=False)
    once = (F.col("flip") >= 0) | (F.col("fp") < F.col("other"))
    light = probes.hint("merge").join(stored.filter("full is null"), ["seg", "key"]).filter(once & _near("fp", "other")).select("fp", "other")
    asked = probes.join(full, ["seg", "key"], "left_semi").withColumnRenamed("flip", "first")
    asked = _ball(_halves(asked), "sub", 16, both_ways=True).drop("rest").withColumnRenamed("first", "flip_seg")
    held = _halves(stored.filter("full")).select("seg", "key", "half", "sub", "other")
    once = (F.col("flip_seg") >= 0) | (F.col("fp") < F.col("other"))
    heavy = asked.hint("merge").join(held, ["seg", "key", "half", "sub"]).filter(once & _near("fp", "other")).select("fp", "other")
    return light.unionByName(heavy)


def classes(made: DataFrame, dense: int = 256) -> DataFrame:
    """(fp, root): the smallest fingerprint that links reach from each of made's distinct ones."""
    distinct = made.select("fp").distinct()
    found = connected_components(links(distinct, dense), "fp", "other").withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, dense: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text): fingerprint as 16 hex digits,
    component_id the smallest doc_id that links reach."""
    made = cut(fingerprints(texts(docs), width), "fingerprints")
    least = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(classes(made, dense), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return made.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
