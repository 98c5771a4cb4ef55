"""Near-duplicates by shingle similarity: SimHash fingerprints of 1024 bits under multi-index hashing find the
candidates, the exact Jaccard similarity of the shingle sets decides.

Two sets of shingles with Jaccard similarity j differ in about acos(2j / (1 + j)) / pi of the fingerprint's
bits: 155 of 1024 at 0.8, give or take 12; sets of a handful of shingles come to 192. Pairs within `SURE` bits,
five deviations below that, link; pairs beyond `REACH`, six above, don't; all between are decided by their sets.

The tables' keys are 84 segments of 24 bits: 42 of neighbouring bytes, and 42 more of bytes that lie apart.
Each fingerprint enumerates a small Hamming ball around every segment: the segment and its neighbour in the bit
whose sum over the shingles was nearest to zero, which is the likeliest to differ in a similar text. Both of a
pair ask, so by calculation a pair at similarity 0.8 shares a segment's ball with probability 0.04 and one of
the 84 with 0.97; at 0.85 with 0.999. 64 further bits travel with the entries, and a pair that differs in more
than 24 of them (five deviations from what 0.8 gives) is let go before anything is joined.

The smallest node that holds a key is its pivot, and all who ask for the key meet the pivot first: a group
of n copies takes a number of pairs in proportion to n, not to its square. Only those whom the pivots did not
bring into one component meet each other after that. Where more than `dense` nodes hold a key, they needn't
meet if both are linked to the pivot, and by the triangle inequality those linked to it meet only those within
twice the REACH. Nothing is capped. Sets are made anew from the texts of those whom they have to decide on.

In a large group of near copies most pairs that share a segment fall short of 0.8. They are told by 1024 further bits: each says
whether an odd number of the set's shingles have its number. Every bit in which two sets differ takes a shingle that only
one of them has, and at 0.8 those are a ninth of both sizes at most, so this refuses no pair that is similar (Mitzenmacher
et al., "Efficient Estimation for High Similarities using Odd Sketches", 2014).

Defined cases: a null or empty text, or one without words, has no shingles and the fingerprint zero; such rows
are copies of each other. Shingles count once. A text of fewer words than a shingle has one shingle. Shingles
and their sets are known by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, cut
from .components import connected_components, thinned

WORDS = 16  # of 64 bits
SURE, REACH = 96, 230  # bits
LOOK = 24  # of the 64 bits that travel along
BITS = 24
#: The bytes of each segment.
PARTS = np.concatenate([np.arange(126).reshape(42, 3), np.arange(126).reshape(3, 42).T])
#: The bits of each segment.
PLACES = (PARTS[:, :, None] * 8 + np.arange(8)).reshape(len(PARTS), BITS)
PROBE = "key int, node long, look long, flip boolean"
#: Odd multipliers, one for each 64 bits of the fingerprint: steps of the golden ratio.
_STEPS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Each 64-bit hash as 1024 bits: (n, 128) bytes."""
    x = hashes[:, None] * _STEPS
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x.astype("<u8", copy=False).view(np.uint8)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct `width`-word shingles, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: both ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        made = {digest(joined)}
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        begin = np.concatenate(([0], ends[: len(words) - width])).tolist()
        made = {digest(joined[a:b]) for a, b in zip(begin, (ends[width - 1 :] - 1).tolist(), strict=True)}
    return np.sort(np.fromiter(made, dtype=np.uint64, count=len(made)))


def _sums(hashes: np.ndarray) -> np.ndarray:
    """For each of the 1024 bits, in how many more hashes it is set than not."""
    bits = np.zeros(64 * WORDS, dtype=np.int64)
    for start in range(0, len(hashes), 255):  # as many as a byte can count
        bits += np.unpackbits(_spread(hashes[start : start + 255]), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * bits - len(hashes)


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of shingles, as 16 unsigned 64-bit numbers, and the least certain bit of each segment."""
    sums = _sums(hashes)
    return np.packbits(sums > 0, bitorder="little").view("<u8"), np.abs(sums)[PLACES].argmin(axis=1).astype(np.uint8)


def odd_bits(hashes: np.ndarray) -> np.ndarray:
    """Of each of 1024 numbers, whether an odd number of the hashes end in it, as 16 unsigned 64-bit numbers."""
    ends = (hashes & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits(np.bincount(ends, minlength=64 * WORDS).astype(np.uint8) & 1, bitorder="little").view("<u8")


def segments(words: np.ndarray) -> np.ndarray:
    """The keys of fingerprints (n, 16): (n, 84)."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 8 * WORDS)[:, PARTS].astype(np.int32)
    return parts[:, :, 0] | parts[:, :, 1] << 8 | parts[:, :, 2] << 16


def wide_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """docs' columns but `text`, with w0..w15, their odd bits o0..o15, `size` (the number of shingles), `weak` (the least
    certain bits) and `node`, a hash of the set of shingles, for every row of docs (text and any other columns)."""
    others, names = [c for c in docs.columns if c != "text"], [*[f"w{i}" for i in range(WORDS)], *[f"o{i}" for i in range(WORDS)], "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            sets = [shingles(x, width) for x in as_bytes(batch.column("text"))]
            pairs = [wide_fingerprint(x) for x in sets]
            made = np.array([[*w, *odd_bits(x), len(x)] for (w, _), x in zip(pairs, sets, strict=True)], dtype="<u8").reshape(-1, len(names))
            words = [pa.array(np.ascontiguousarray(made[:, i]).view("<i8")) for i in range(len(names))]
            weak = pa.array([x.tobytes() for _, x in pairs], pa.binary())
            node = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *words, weak, node], [*others, *names, "weak", "node"])

    schema = docs.drop("text").schema
    for name in names:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema.add("weak", "binary").add("node", "long"))


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PROBE: each segment as it is held, and with its least certain bit changed, as it is asked for."""
    first = (np.arange(len(PARTS), dtype=np.int32) << BITS)[None]
    for whole in batches:
        for i in range(0, whole.num_rows, 2000):
            batch = whole.slice(i, 2000)
            words = np.stack([batch.column(f"w{k}").to_numpy() for k in range(WORDS)], axis=1)
            weak = np.frombuffer(b"".join(batch.column("weak").to_pylist()), dtype=np.uint8).reshape(-1, len(PARTS)).astype(np.int32)
            held = segments(words) | first
            node, look = (np.repeat(x, 2 * len(PARTS)) for x in (batch.column("node").to_numpy(), words[:, WORDS - 1]))
            key = np.concatenate([held, held ^ (1 << weak)], axis=1).ravel()
            flip = np.tile(np.arange(2 * len(PARTS)) >= len(PARTS), len(words))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, look, flip)], ["key", "node", "look", "flip"])


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of docs (node, text), one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            made = [shingles(x, width).view(np.int64) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<bigint>").dropDuplicates(["node"])


def _distance(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{left}0").bitwiseXOR(F.col(f"{right}0"))))


def _renamed(fps: DataFrame, node: str, word: str) -> DataFrame:
    words, odd = ([F.col(f"{x}{i}").alias(f"{y}{i}") for i in range(WORDS)] for x, y in (("w", word), ("o", f"{word}o")))
    return fps.select(F.col("node").alias(node), *words, *odd, F.col("size").alias(f"{word}size"))


def _possible(left: str, right: str) -> Column:
    """Whether the sets can have a similarity of 0.8: both / (x + y - both) >= 0.8 if x + y - 2 both <= (x + y) / 9."""
    return 9 * _distance(f"{left}o", f"{right}o") <= F.col(f"{left}size") + F.col(f"{right}size")


def _measured(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """pairs (a, b and any others) with their complete distance d, and whether they are within REACH and may be similar."""
    both = pairs.join(_renamed(fps, "a", "l"), "a").join(_renamed(fps, "b", "r"), "b")
    return both.select(*pairs.columns, _distance("l", "r").alias("d"), ((_distance("l", "r") <= REACH) & _possible("l", "r")).alias("possible"))


def _alike(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= LOOK


def _verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v): the pairs (a, b, d) within SURE bits, and those whose sets have a Jaccard similarity of 0.8 or
    more. sets: (node, shingles) of the nodes of a table."""
    asked = cut(pairs.select("a", "b", "d").distinct(), "candidates")
    far = asked.filter(F.col("d") > SURE).select("a", "b")
    own = cut(sets(far.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    left, right = (own.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    alike = 9 * both >= 4 * (F.size("x") + F.size("y"))  # both / (x + y - both) >= 0.8
    found = far.join(left, "a").join(right, "b").filter(alike).select("a", "b")
    return cut(found.unionByName(asked.filter(F.col("d") <= SURE).select("a", "b")).toDF("u", "v"), "similar")


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (a, b and d, if there) that are not in one component. stars: node, root.

    A node's roots are looked up once for all that it is paired with, at most a key's number of nodes, and those of
    the others once for each component that they are paired with, so that a large component asks no more often
    than its pairs have different ends."""
    held = F.struct(*[c for c in pairs.columns if c != "a"])
    own = pairs.groupBy("a").agg(F.collect_list(held).alias("others"))
    own = own.join(stars.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("root", "a").alias("x"), F.explode("others").alias("o"))
    own = cut(own.select("a", "x", "o.*"), "paired")
    ends = own.select("x", "b").distinct().join(stars.withColumnsRenamed({"node": "b", "root": "y"}), "b", "left")
    return own.join(ends.filter(F.col("x") != F.coalesce("y", "b")).select("x", "b"), ["x", "b"], "left_semi").select(*pairs.columns)


def _met(asked: DataFrame, held: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b, d): who asked for a key that b of another component holds, each pair from one side where both hold
    it, looks alike, is within REACH and may be similar. The fingerprints come to the keys, so that no candidate is shuffled."""
    asked = asked.join(_renamed(fps, "node", "l"), "node")
    held = held.select("key", F.col("node").alias("b"), F.col("look").alias("there"), F.col("root").alias("other"))
    held = held.join(_renamed(fps, "b", "r"), "b")
    once: Column = F.col("flip") | (F.col("node") < F.col("b"))
    apart = F.col("root") != F.col("other")
    met = asked.join(held, "key").filter(once & apart & _alike("look", "there") & _possible("l", "r"))
    return met.select(F.col("node").alias("a"), "b", _distance("l", "r").alias("d")).filter(F.col("d") <= REACH)


def links(fps: DataFrame, sets: Callable[[DataFrame], DataFrame], dense: int = 256) -> DataFrame:
    """(u, v): edges with the components of all pairs that share a segment's ball and are similar.

    fps: distinct `node`, w0..w15, o0..o15, size, weak. sets: (node, shingles) of the nodes of a table."""
    rows = fps.select("node", *[f"w{i}" for i in range(WORDS)], "weak").mapInArrow(_probes, PROBE).repartition("key")
    pivot = F.min(F.when(~F.col("flip"), F.struct("node", "look")))
    keys = rows.groupBy("key").agg(pivot.alias("p"), F.count_if(~F.col("flip")).alias("n")).filter("n > 0")
    keys = keys.select("key", F.col("p.node").alias("pivot"), F.col("p.look").alias("sight"), (F.col("n") > dense).alias("full"), (F.col("n") > 1).alias("shared"))
    asked = cut(rows.join(keys, "key").filter("shared or flip").filter(F.col("shared") | _alike("look", "sight")), "asked", free=True)

    # Each node meets the smallest of its pivots first, then those that are not in its component by then.
    met = asked.filter((F.col("node") != F.col("pivot")) & (F.col("full") | _alike("look", "sight")))
    met = cut(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "to-pivots", free=True)
    first = _measured(met.groupBy("a").agg(F.min("b").alias("b")), fps).filter("possible")
    stars = connected_components(thinned(_verified(first, sets)), "u", "v")
    near = cut(_measured(_apart(met, stars), fps).filter("possible"), "near-pivots")
    known = stars.select(F.col("node").alias("u"), F.col("root").alias("v"))
    sure = near.filter(F.col("d") <= SURE).select(F.col("a").alias("u"), F.col("b").alias("v"))
    sure = connected_components(thinned(known.unionByName(sure)), "u", "v")
    edges = _verified(_apart(near.filter(F.col("d") > SURE), sure), sets).unionByName(sure.select(F.col("node").alias("u"), F.col("root").alias("v")))
    stars = connected_components(thinned(edges), "u", "v")

    # Those who met at a key's pivot and are in one component need not meet; the others do.
    asked = asked.filter("shared").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = asked.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    asked = cut(asked.join(ends, "key", "left_semi"), "apart")
    held = asked.filter("not flip")
    far = asked.filter("full").filter(F.col("node") != F.col("pivot")).groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("root").alias("x"))
    far = _measured(far, fps).join(stars.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    linked = (F.col("x") == F.coalesce("y", "b")) & (F.col("d") <= REACH)
    far = far.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d", linked.alias("linked"))
    light = _met(asked.filter("not full"), held.filter("not full"), fps)
    own = {"d": F.coalesce("d", F.lit(0)), "linked": F.coalesce("linked", F.lit(True))}  # the pivot itself
    asked, held = (x.filter("full").join(far, ["node", "pivot"], "left").withColumns(own) for x in (asked, held))
    rest = _met(asked.filter("not linked"), held, fps)
    rest = rest.unionByName(_met(asked.filter("linked"), held.filter(~F.col("linked") & (F.col("d") <= 2 * REACH)), fps))
    return _verified(light.unionByName(rest), sets).unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))


def without_similar(docs: DataFrame, width: int = 5, dense: int = 256) -> DataFrame:
    """The rows of docs, with all columns, that stay when one of each component stays: the one with the
    smallest doc_id, rows without an id last, then by the text's hashes; of repeated rows one."""
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit(7), plain).alias("k2"))
    named = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), order.alias("at"))
    made = cut(wide_fingerprints(named.select("at", "text"), width), "wide-fingerprints")
    own = made.groupBy("node").agg(F.min("at").alias("first"))
    fps = cut(made.drop("at").dropDuplicates(["node"]), "fingerprints", free=True)

    def sets(nodes: DataFrame) -> DataFrame:
        first = own.join(nodes, "node", "left_semi").select("node", "first")
        same = [F.col(f"at.{c}").eqNullSafe(F.col(f"first.{c}")) for c in ("none", "id", "k1", "k2")]
        return sets_of(named.join(first, same[0] & same[1] & same[2] & same[3]), width)

    found = connected_components(links(fps, sets, dense), "u", "v")
    rooted = own.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first")
    same = [F.col(f"at.{c}").eqNullSafe(F.col(f"first.{c}")) for c in ("none", "id", "k1", "k2")]
    one = Window.partitionBy("at").orderBy(F.lit(1))
    rows = named.join(kept, same[0] & same[1] & same[2] & same[3], "left_semi").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
