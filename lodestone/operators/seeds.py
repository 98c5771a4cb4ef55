"""All occurrences of many patterns in many texts (STR-10, EVL-1).

Of every window of neighbouring grams a text keeps the one with the smallest hash (Schleimer, Wilkerson and Aiken,
"Winnowing", 2003), about two in a window. A pattern keeps the smallest of its first window. Where the pattern occurs,
the text has the same window at that place and so has kept the same gram. Texts meet grams with the lengths of their
patterns there, however many patterns begin alike; the letters of each such place are then looked up among the patterns
as they are, once for each occurrence, those that overlap too. Windows are as wide as a pattern's length allows, in a few
classes of length; only classes that patterns have are worked out.

Defined cases: null and empty patterns occur nowhere, null texts hold nothing. Letters are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut, few

#: Least length of a pattern, and the grams and windows (in grams) of its class: window + gram - 1 letters at most.
CLASSES = [(64, 8, 57), (24, 8, 17), (12, 8, 5), (5, 5, 1), (4, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1)]
#: At most so many rows of grams and lengths go to every task.
BROADCAST = 200_000
#: Letters of texts that are worked out in one.
TOGETHER = 1 << 20
_PLACE = np.uint64((1 << 27) - 1)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` letters."""
    n = len(codes) - size + 1
    made = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(made)] + np.uint64(1)
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(29))


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest hash of each window, of equals the first; hashes are compared by their upper 37 bits. Places
    never go back from a window to the next."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while wide * 2 <= window:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    if wide < window:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    return (least & _PLACE).astype(np.int64)


def _kept(hashes: np.ndarray, window: int) -> np.ndarray:
    return np.unique(_least(hashes, window))


def kept_of_all(texts: list[str], size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, hashes) that each of some texts keeps, worked out in one: windows that reach into the next text don't count."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends, row = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
    hashes = _grams(codes, size)
    at = _least(hashes, window)
    at = at[np.arange(len(at)) + window + size - 1 <= ends[row[: len(at)]]]
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    own = row[at]
    return own, at - (ends - sizes)[own], hashes[at]


def _some(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` letters; a longer text is alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def kept_grams(text: str, size: int, window: int, part: int = 1 << 26) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) that a text keeps; very long texts go through in parts that share a window's letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    places, hashes = [], []
    for start in range(0, max(1, len(codes)), part):
        h = _grams(codes[start : start + part + size + window - 2], size)
        at = _kept(h, window)
        places.append(at + start)
        hashes.append(h[at])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _kept_of(texts: list[str], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, hashes) that texts keep for a class; a very long text comes alone."""
    _, size, window = CLASSES[number]
    if len(texts) > 1:
        return kept_of_all(texts, size, window)
    at, hashes = kept_grams(texts[0], size, window)
    return np.zeros(len(at), dtype=np.int64), at, hashes


def _shaped(row: np.ndarray, at: np.ndarray, hashes: np.ndarray, grams: np.ndarray, ahead: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, begins, lengths) of all places where kept grams meet a pattern's, some at a time; grams are sorted."""
    own = hashes.view(np.int64)
    first = np.searchsorted(grams, own, "left")
    count = np.searchsorted(grams, own, "right") - first
    met = np.flatnonzero(count)
    part = np.cumsum(count[met]) // TOGETHER
    for some in np.split(met, np.flatnonzero(np.diff(part)) + 1) if len(met) else ():
        n = count[some]
        which, shape = np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
        yield row[which], at[which] - ahead[shape], size[shape]


def _rows(number: int, at: np.ndarray, hashes: np.ndarray, key: pa.Array, name: str) -> pa.RecordBatch:
    n = len(at)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at), key.take(pa.array(np.zeros(n, np.int64)))], ["cls", "gram", "at", name])


def _class(pattern: Column) -> Column:
    made = F.lit(None).cast("int")
    for i in reversed(range(len(CLASSES))):
        made = F.when(F.length(pattern) >= CLASSES[i][0], i).otherwise(made)
    return made


def occurrences(texts: DataFrame, patterns: DataFrame, key: str, pattern_id: str, places: bool = True) -> DataFrame:
    """(key, pattern_id, at): every place, from 1 on, where a pattern (pattern_id, pattern) begins in a text (key, text). Keys and
    ids are unique and not null; repeated rows count once. Without places: (key, pattern_id) of those that occur."""
    texts = texts.select(key, "text").filter(F.col("text").isNotNull())
    patterns = patterns.select(pattern_id, "pattern").filter(F.length("pattern") > 0).withColumn("cls", _class(F.col("pattern")))
    present = sorted(r.cls for r in patterns.select("cls").distinct().collect())  # no more than there are classes
    gram = "cls int, gram long, at long"

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).to_pylist()
            for start, end in _some(every, TOGETHER):
                for number in present:
                    row, at, hashes = _kept_of(every[start:end], number)
                    if len(at):
                        names = batch.column(0).take(pa.array(row + start))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at), names], ["cls", "gram", "at", key])

    def of_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, number) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                _, size, window = CLASSES[number]
                at, hashes = kept_grams(text[: size + window - 1], size, window)
                yield _rows(number, at, hashes, batch.column(0).slice(i, 1), pattern_id)

    wanted = patterns.mapInArrow(of_patterns, f"{gram}, {pattern_id} {patterns.schema[pattern_id].dataType.simpleString()}").withColumnRenamed("at", "ahead")
    sizes = patterns.select(pattern_id, F.length("pattern").alias("size")).distinct()
    shapes = cut(wanted.join(sizes, pattern_id).select("cls", "gram", "ahead", "size").distinct())
    named, told = patterns.select(pattern_id, "pattern").distinct(), [key, pattern_id, *(["at"] if places else [])]
    kind = texts.schema[key].dataType.simpleString()
    if shapes.limit(BROADCAST + 1).count() <= BROADCAST:  # few grams go to the texts, so that neither what texts keep nor texts are shuffled
        shapes = shapes.toArrow().sort_by([("cls", "ascending"), ("gram", "ascending")])
        number, grams, ahead, size = (shapes.column(c).to_numpy() for c in ("cls", "gram", "ahead", "size"))
        of_class = {n: (grams[number == n], ahead[number == n], size[number == n].astype(np.int64)) for n in present}

        def near_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = batch.column(1).to_pylist()
                for start, end in _some(every, TOGETHER):
                    part = every[start:end]
                    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                    for row, at, long in (x for n in present for x in _shaped(*_kept_of(part, n), *of_class[n])):
                        there = (at >= 0) & (at + long <= lengths[row])
                        row, at, long = np.unique(np.stack([row[there], at[there], long[there]]), axis=1)
                        pieces = [part[r][a : a + m] for r, a, m in zip(row.tolist(), at.tolist(), long.tolist(), strict=True)]
                        if places:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + start)), pa.array(at + 1), pa.array(pieces, pa.string())], [key, "at", "pattern"])
                        else:
                            held = list(dict.fromkeys(zip(row.tolist(), pieces, strict=True)))
                            row, pieces = np.array([r for r, _ in held], dtype=np.int64), [x for _, x in held]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + start)), pa.array(pieces, pa.string())], [key, "pattern"])

        near = texts.mapInArrow(near_grams, f"{key} {kind}, " + ("at long, " if places else "") + "pattern string")
        return near.join(few(named), "pattern").select(*told).distinct()
    seeds = texts.mapInArrow(of_texts, f"{gram}, {key} {kind}")
    met = seeds.join(shapes, ["cls", "gram"]).select(key, (F.col("at") - F.col("ahead") + 1).alias("at"), "size").filter("at > 0").distinct()
    near = met.join(texts, key).select(key, "at", F.col("text").substr(F.col("at").cast("int"), F.col("size")).alias("pattern"))
    return near.join(named, "pattern").select(*told).distinct()
