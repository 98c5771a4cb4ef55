"""Packing: best-fit decreasing, with a segment tree over remaining capacities.

Pieces are placed from the longest to the shortest, each into the open sequence with the smallest gap that still
holds it; where none does, a new one is opened. Which sequence that is depends on lengths alone, and there are at
most `size` of them. So the tasks only count pieces by length; the placement runs over these counts, a run of
equal pieces at a step, and gives what placing the pieces of the whole corpus one by one would. Its steps (a few for each
length, whatever the number of pieces) go back to the tasks: the place of a piece follows from its length and its
number among the pieces of that length. No piece's ids are shuffled, and the number of sequences depends neither
on partitions nor on their number.

Defined cases: a null text is empty; an empty text is the end id alone. Repeated rows are packed as often as they
occur; a null id stays null. Other columns are ignored, whatever their names. An empty table gives an empty
result. A text of any length is cut into whole sequences and a rest. Of equal gaps the one opened last is taken.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, table, texts
from .packing import word_encoder

ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Gaps:
    """How many groups of open sequences there are of each gap, as a segment tree: a node has the sum of its two."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, gap: int, n: int) -> None:
        node = gap + self.leaves
        while node:
            self.sums[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest gap of at least need."""
        node = need + self.leaves
        if self.sums[node]:
            return need
        while node & 1 or not self.sums[node + 1]:  # up, to the first subtree on the right that has any
            node >>= 1
            if node < 2:
                return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.sums[2 * node] else 2 * node + 1
        return node - self.leaves


def placement(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, rank, sequence, each, offset) of best-fit decreasing for counts[length] pieces of each length:
    from its rank on, until the next step of that length, pieces go by `each` into consecutive sequences from
    `sequence` on, the first of each at `offset`.

    After a piece has gone into the tightest gap, what is left of that gap is tighter still; so equal pieces fill one
    sequence while it holds another, then the next. A group of sequences with equal gaps is first, number and gap.
    A step that uses a group up leaves less than half of its gap, and a length's last step alone splits a group, so there
    are at most some log2(size) steps for each of 3 * size groups."""
    gaps, groups = Gaps(size), defaultdict(list)
    steps, opened = [], 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            groups[gap].append((first, n))
            gaps.add(gap, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = gaps.tightest(length)
            if gap is None:
                gap, first, n = size, opened, -(-left // (size // length))
                opened += n
            else:
                first, n = groups[gap].pop()
                gaps.add(gap, -1)
            each = gap // length
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            steps.append((length, rank, first, each, size - gap))
            keep(gap, first + full + bool(rest), n - full - bool(rest))
            keep(gap - each * length, first, full)
            keep(gap - rest * length, first + full, int(bool(rest)))
            rank, left = rank + placed, left - placed
    return steps


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Rows of ITEMS for all docs (doc_id, text): ids of the text and the end id, cut at every `size` ids. nth numbers the
    pieces of one length within a part, the scan's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in by_bytes(batches, "text", 1 << 20):
            ids = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            rows = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                x += end
                for piece, at in enumerate(range(0, len(x), 4 * size)):
                    own = x[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ITEMS.split(", ")])

    return texts(docs).mapInArrow(run, ITEMS)


def best_fit(items: DataFrame, size: int) -> DataFrame:
    """items (length from 1 to size, part, nth, and any others) with sequence_id and offset in place of part and nth.
    items must be a stored table: it is read once to count and once to place.

    The driver gets one count for each length, at most `size` rows. Numbers within a length over the whole table
    are a part's numbers and the counts of the parts before, one row for each part and length."""
    bits = 62 - size.bit_length()
    by_part = items.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(sorted(placement(counts, size)), dtype=np.int64).reshape(-1, 5)
    keys = (steps[:, 0] << bits) + steps[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    schema = items.drop("part", "nth").schema.add("sequence_id", "long").add("offset", "long")
    names = items.drop("part", "nth").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth, shift = (batch.column(x).to_numpy() for x in ("length", "nth", "shift"))
            rank = nth + shift
            step = np.searchsorted(keys, (length << bits) + rank, side="right") - 1
            _, first, sequence, each, offset = steps[step].T
            ahead = rank - first
            places = [sequence + ahead // each, offset + ahead % each * length]
            columns = [batch.column(x) for x in names] + [pa.array(x) for x in places]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return items.join(shifts, ["part", "length"]).mapInArrow(run, schema)


def pack_best_fit(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Pieces of all docs (doc_id, text) as rows of PLACED, in sequences of at most `size` ids. vocabulary: a tokenizers
    file that every executor has at this path and whose pre-tokenizer splits at white space."""
    return best_fit(cut(pieces(docs, vocabulary, end_id, size), "pieces"), size).select(*[x.split()[0] for x in PLACED.split(", ")])


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
