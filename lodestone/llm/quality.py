"""Quality rules: compression bands.

zstandard ratios (compressed bytes over bytes) of the whole document and of its fixed chunks reject text
that is repetitive (below its band) or incompressible (above it). The limits depend on the length, since
short texts compress less. They lie well outside what prose of any of the corpus languages reaches.

A text's last chunk, which may be shorter, is held against the limits of its own length. A text goes if more than
`odd_share` of its chunks lie outside their limits.

Defined cases: a null or empty text has no words, so it fails the base rule and is not kept. Repeated rows
give repeated results. Other columns are ignored. An empty table gives an empty result. Texts of any length
are read whole.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, as_bytes, by_bytes, table, texts

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_odd_chunks long"
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Upper ends of the length classes in bytes, and the lowest and highest ratio accepted in each class
    (one more than there are ends). Texts of the first class are too short for a ratio to say anything."""

    ends: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536)
    low: tuple[float, ...] = (0.0, 0.45, 0.38, 0.38, 0.37, 0.36, 0.35, 0.33, 0.32, 0.30, 0.27)
    high: tuple[float, ...] = (9.0, 1.25, 1.05, 0.92, 0.84, 0.78, 0.74, 0.72, 0.70, 0.70, 0.70)
    chunk_bytes: int = 4096
    odd_share: float = 0.5  # a document is rejected if more than this share of its chunks lies outside the band
    level: int = 3

    def outside(self, size: int, ratio: float) -> bool:
        k = bisect.bisect_left(self.ends, size)
        return not self.low[k] <= ratio <= self.high[k]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that are found twice or more in the text, each word counted once."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    # Two windows are equal if their parts are: code pairs, then pairs of pairs, then the last word.
    window, reach = code, 1
    while reach < width:
        step = min(reach, width - reach)
        pair = window[: len(window) - step] * (int(code.max(initial=0)) + len(words) + 1) + window[step:]
        window = np.unique(pair, return_inverse=True)[1]
        reach += step
    again = np.bincount(window)[window] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    """The row of SCHEMA for one text, without its id."""
    words = text.split()  # of bytes: splits at the six ASCII white space characters only
    shown = text.decode("utf-8")
    n = len(words)
    chars = len(shown) - sum(map(shown.count, WORD_SPACE))
    symbols = sum(map(shown.count, SYMBOLS))
    lines = Counter(x for x in text.split(b"\n") if x and not x.isspace())
    dup_lines = sum(lines.values()) - len(lines)
    again = repeated_words(words)
    failed = n < 10 or 100 * again > 20 * n
    ratio = len(press.compress(text)) / len(text) if text else 0.0
    step = bands.chunk_bytes
    odd = count = 0
    if len(text) > step:
        for start in range(0, len(text), step):
            size = min(step, len(text) - start)
            count += 1
            odd += bands.outside(size, len(press.compress(text[start : start + size])) / size)
    kept = not failed and not bands.outside(len(text), ratio) and not odd > bands.odd_share * count
    return n, chars, symbols, dup_lines, again, failed, kept, ratio, count, odd


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of SCHEMA per row of docs (doc_id, text). Each row is judged by itself: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in by_bytes(batches, "text", 8 << 20):
            rows = list(zip(*(judge(x, bands, press) for x in as_bytes(batch.column("text"))), strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            made = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    return texts(docs).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all columns, that the rules keep."""

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        return pa.array([judge(x, bands, press)[6] for x in as_bytes(text)], pa.bool_())

    return docs.filter(kept(F.col("text").cast("string")))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
