"""Packing: sum-of-squares online packing.

Each document goes to the fill level that leaves the smallest sum of squared counts of partially filled
windows; the counts are kept in a level array. Levels are steps of `grain` ids, so that a few hundred documents
are enough for the counts to even out and windows to close; the last gap of a window, less than a step, is
filled with the beginning of the next document. Documents of a window or more are first cut into whole windows
and a tail. Each task packs its documents online. At the end of a task the windows still open are levelled: the
gaps of the fullest are filled with cuts from the emptiest, which leaves one open window; so they are when very
many are open. The rest windows of many tasks are levelled once more, so padding comes to less than a window
for every `group` tasks.

Defined cases: a null text is empty; an empty text is the end id alone. Repeated rows are packed as often as
they occur. Other columns are ignored. An empty table gives an empty result. A text of any length is cut.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, table, texts

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = PIECE + ", rest_ids binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([(x, pa.int64()) for x in NAMES[:-1]] + [("rest_ids", pa.binary())])
#: Characters at which Python splits and the vocabulary's white space rule doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer never joins what white space parts: each word is
    encoded once while it stays in a cache of at most 2 * `words` short words. Where the vocabulary has no
    upper case, texts in Latin-1 are lower-cased first, so that words differ less."""

    def __init__(self, path: str, words: int = 600_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.words, self.longest = words, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = "".join(map(chr, range(33, 127))) + "".join(map(chr, range(161, 256)))
        self.folds = self._ids([probe]) == self._ids([probe.lower()])
        self.marks = [x.content for x in self.model.get_added_tokens_decoder().values()]

    def _folded(self, text: str) -> str:
        """The text in lower case if that can't change its ids: special strings are matched as they stand."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(x in low for x in self.marks) else low

    def _ids(self, strings: list[str]) -> list[bytes]:
        made = self.model.encode_batch_fast(strings, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words that the young cache hasn't got, which gets those of short ones."""
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        made = {x: self.old[x] for x in missing & self.old.keys()}
        fresh = list(missing.difference(made))
        made.update(zip(fresh, self._ids(fresh), strict=True))
        self.young.update(x for x in made.items() if len(x[0]) <= self.longest)
        return made

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = []
        missing: set[str] = set()
        gaps = []
        known = self.young.get
        for n, text in enumerate(batch):
            if any(c in text for c in NOT_SPACE):
                out.append(self._ids([text]))
                continue
            words = (self._folded(text) if self.folds else text).split()
            ids = list(map(known, words))
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                here = [words[i] for i in at]
                missing.update(here)
                gaps.append((n, at, here))
            out.append(ids)
        made = self._learn(missing)
        for n, at, here in gaps:
            ids = out[n]
            for i, word in zip(at, here, strict=True):
                ids[i] = made[word]
        return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker process, which so share its cache."""
    return WordEncoder(path)


class Packer:
    """Sum-of-squares packing of (doc_id, start, ids, doc_tokens) pieces into windows of `size` ids.

    level[k]: open windows with k * grain ids and less than a grain more. A piece put into a window of level k that
    then is of level n changes the sum of squares by 2 * (level[n] - level[k]) + 2, where windows that lack less
    than a grain, and new ones, don't count. settled: windows that were closed by levelling."""

    def __init__(self, size: int, first: int, grain: int = 1, max_open: int = 4096):
        self.size, self.next, self.grain, self.max_open = size, first, grain, max_open
        self.level = np.zeros(size // grain + 1, dtype=np.int64)
        self.top = np.full(size // grain + 1, -1, dtype=np.int64)  # ids in each level's last window
        self.at: dict[int, list[tuple[int, list]]] = {}  # level -> (ids, pieces) of its windows
        self.gap: tuple[int, list] | None = None  # a window that lacks less than a grain
        self.open = self.settled = 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total, self.size):
            part = ids[4 * start : 4 * (start + self.size)]
            piece = (doc_id, start, part, total)
            if len(part) == 4 * self.size:
                self._close([piece])
                continue
            if self.gap:
                piece = self._topped(*piece)
            if piece:
                self._place(piece)
        if self.open > self.max_open:
            self.settle()

    def _topped(self, doc_id, start: int, ids: bytes, total: int) -> tuple | None:
        """What is left of a piece whose beginning went into the gap."""
        fill, window = self.gap
        n = min(len(ids) // 4, self.size - fill)
        window.append((doc_id, start, ids[: 4 * n], total))
        self.gap = (fill + n, window)
        if fill + n == self.size:
            self._close(window)
            self.gap = None
        return (doc_id, start + n, ids[4 * n :], total) if len(ids) > 4 * n else None

    def _place(self, piece: tuple) -> None:
        size, level, grain = len(piece[2]) // 4, self.level, self.grain
        fill = self.top + size
        after = np.minimum(fill // grain, len(level) - 1)
        change = 2 * (level[after] - level) + 2
        near = self.size - fill < grain
        change[near] = 1 - 2 * level[near]  # no partial window is added
        change[after == np.arange(len(level))] = 0  # stays in its level
        change[(self.top < 0) | (fill > self.size)] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
        fresh = 0 if self.size - size < grain else 2 * level[size // grain] + 1
        window = self._take(best) if change[best] <= fresh else (0, [])
        self._put(window[1], window[0] + size, piece)

    def _take(self, k: int) -> tuple[int, list]:
        windows = self.at[k]
        taken = windows.pop()
        self.level[k] -= 1
        self.open -= 1
        self.top[k] = windows[-1][0] if windows else -1
        return taken

    def _put(self, window: list, fill: int, piece: tuple) -> None:
        window.append(piece)
        if fill == self.size:
            self._close(window)
        elif self.size - fill < self.grain and self.gap is None:
            self.gap = (fill, window)
        else:
            self._keep(fill, window)

    def _keep(self, fill: int, window: list) -> None:
        k = fill // self.grain
        self.level[k] += 1
        self.open += 1
        self.at.setdefault(k, []).append((fill, window))
        self.top[k] = fill

    def _close(self, window: list) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, None))
            offset += n
        self.next += 1

    def settle(self) -> None:
        """Fills the gaps of the fullest windows with cuts from the emptiest; at most one stays open."""
        order = sorted((x for windows in self.at.values() for x in windows), key=lambda x: x[0])
        if self.gap:
            order.append(self.gap)
            self.gap = None
        self.level[:], self.top[:] = 0, -1
        self.at, self.open = {}, 0
        low = 0
        spare = list(order[0][1]) if order else []
        for high in range(len(order) - 1, 0, -1):
            if high <= low:
                break  # what is left of the emptiest is in spare
            fill, window = order[high]
            while fill < self.size:
                if not spare:
                    low += 1
                    if low == high:
                        break
                    spare = list(order[low][1])
                doc_id, start, ids, total = spare.pop()
                n = min(len(ids) // 4, self.size - fill)
                window.append((doc_id, start, ids[: 4 * n], total))
                if len(ids) > 4 * n:
                    spare.append((doc_id, start + n, ids[4 * n :], total))
                fill += n
            if fill < self.size:
                spare = window
                break
            self._close(window)
            self.settled += 1
        if spare:
            self._keep(sum(len(x[2]) for x in spare) // 4, spare)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            columns = zip(*self.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ARROW, strict=True)], schema=ARROW)
            self.done = []

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The open window, with its ids, for the next level."""
        self.settle()
        yield from self.rows()
        for _, window in chain.from_iterable(self.at.values()):
            self._close(window)
            self.done = [(*x[:-1], p[2]) for x, p in zip(self.done, window, strict=True)]
        yield from self.rows()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 4096, group: int = 64, grain: int = 64) -> DataFrame:
    """Pieces of all docs (doc_id, text) as rows of PIECE. vocabulary: a tokenizers file that every executor
    has at this path and whose pre-tokenizer splits at white space. Sequences hold at most `size` ids.

    The first pass runs on the scan's partitions, without a shuffle; only rest windows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 32, min(grain, max(1, size // 16)))
        for batch in by_bytes(batches, "text", 1 << 20):
            ids = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                packer.add(doc_id, x + end)
            yield from packer.rows()
        yield from packer.rest()

    def level(key: tuple, rest: pa.Table) -> pa.Table:
        packer = Packer(size, (1 << 62) + (key[0].as_py() << 32))
        rows = rest.select(["sequence_id", "offset", "doc_id", "start", "rest_ids", "doc_tokens"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows: dict[int, list] = {}
        for sequence, _, *piece in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            windows.setdefault(sequence, []).append(tuple(piece))
        for window in windows.values():
            packer._put(window[:-1], sum(len(x[2]) for x in window) // 4, window[-1])
        made = list(packer.rest())
        return pa.Table.from_batches(made, ARROW).select(NAMES[:-1])

    first = cut(texts(docs).mapInArrow(run, SCHEMA), "packed")
    rest = first.filter(F.col("rest_ids").isNotNull())
    key = F.shiftright("sequence_id", 32 + (group - 1).bit_length())
    rest = rest.groupBy(key.alias("part")).applyInArrow(level, PIECE)
    return first.filter(F.col("rest_ids").isNull()).drop("rest_ids").unionByName(rest)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
