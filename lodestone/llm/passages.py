"""Substring dedup: repeated-phrase automata.

A window of `width` words recurs if its words also start anywhere else. Every word in a recurring window is
removed. Three steps find them without moving all windows:

1. Phrases. Each window picks, of the `gram`-word phrases in it, the one with the least hash; equal windows
   pick equal phrases, so only phrases picked twice or more matter. Neighbouring windows mostly pick the same
   one, and a phrase with the stretch of words that its windows span is one row instead of many.
2. Passages. Stretches that occur twice or more recur as a whole. Where a phrase recurs and one of its
   stretches does not, one place of each is read again and taken apart into windows, each counted as often as
   the stretch occurs; a window is known by its phrase's and its own hash, 128 bits together. The words of
   recurring stretches and windows are then read from one place each: these are the confirmed passages, from
   here on word sequences without a place.
3. Automata. Documents are dealt into shards of about `shard_bytes`. A shard gets, from all over the corpus,
   the passages whose stretches its documents hold, compiles them into an Aho-Corasick automaton over words,
   and streams every one of its documents through it. Only the automaton says where a passage occurs, and it
   compares words, not hashes.

A document's shard depends on its text and its other plain columns, so copies of a text with different ids
lie in many shards, and a passage that very many documents share comes to each shard once for each stretch.

Defined cases: a null text has no words. Texts under `width` words are kept. Other columns, whatever their
names, are kept or ignored. Repeated rows, and rows without an id, are windows like any other. An empty table
gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType, VariantType

from .common import as_bytes, by_bytes, cut, table, texts

FACTOR = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OCCURRENCE = "anchor long, stretch long, shard long, row_key long, start int, windows int"
WINDOW = "anchor long, window long, n long, row_key long, start int"
PASSAGE = "passage long, words binary, spans binary, keys array<struct<anchor:bigint,stretch:bigint>>"
CUT = "text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,words:int>>"
TOKEN = re.compile(rb"([^\x20\x09-\x0d]+)([\x20\x09-\x0d]*)")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Spans:
    """Hashes of any span of words, from sums of powers of one factor modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, FACTOR)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)))
        back = np.full(n + 1, BACK)
        back[:1] = 1
        self.back = np.multiply.accumulate(back)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.back[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def picked(spans: Spans, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another, each word's text ending at `ends`: the picked phrases' hashes, and the first
    of the windows that pick each, and how many do."""
    n = len(ends)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none.astype(np.uint64), none, none
    at = np.arange(n - gram + 1)
    phrase = spans.of(at, at + gram)
    first = np.arange(n - width + 1)
    place = first + np.lib.stride_tricks.sliding_window_view(phrase, width - gram + 1).argmin(axis=1)
    whole = first + width <= ends[: n - width + 1]
    first, place = first[whole], place[whole]
    if not len(first):
        return none.astype(np.uint64), none, none
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return phrase[place[new]], first[new], np.diff(np.append(new, len(first)))


def _words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of all texts, and for each its text and where that ends."""
    parts = [x.split() for x in as_bytes(column)]  # of bytes: at ASCII white space
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    return [w for p in parts for w in p], np.repeat(np.arange(len(parts)), sizes), np.repeat(ends, sizes)


def recurring_stretches(own: DataFrame, width: int, gram: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Occurrences (OCCURRENCE) of recurring phrases; (anchor, stretch, n, one): each distinct stretch, how
    often it occurs, and one place of it; and the number of shards. own: row_key, text."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            words, _, ends = _words(batch.column("text"))
            anchor, _, _ = picked(Spans(word_hashes(words)), ends, width, gram)
            value, n = np.unique(anchor, return_counts=True)
            size = sum(x or 0 for x in pc.binary_length(batch.column("text")).to_pylist())
            columns = [pa.concat_arrays([pa.array(value.view(np.int64)), pa.nulls(1, pa.int64())]), pa.array([*n.tolist(), size], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "n"])

    # The row without a phrase holds the bytes of all texts.
    again = cut(own.select("text").mapInArrow(phrases, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("anchor is null or n > 1"), "phrases", free=True)
    size, picks = again.agg(F.max(F.when(F.col("anchor").isNull(), F.col("n"))), F.sum(F.when(F.col("anchor").isNotNull(), F.col("n")))).first()
    shards = (size or 0) // shard_bytes + 1

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            words, text, ends = _words(batch.column("text"))
            spans = Spans(word_hashes(words))
            anchor, first, n = picked(spans, ends, width, gram)
            stretch = spans.of(first, first + n + (width - 1))
            sizes = np.bincount(text, minlength=batch.num_rows)
            begin, of = np.cumsum(sizes) - sizes, text[first] if len(first) else first
            key = batch.column("row_key").to_numpy()[of]
            columns = [anchor.view(np.int64), stretch.view(np.int64), key % shards, key, (first - begin[of]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "stretch", "shard", "row_key", "start", "windows"])

    # Fewer than `most` phrases hold more than a `most`-th of all picks each, so they may be broadcast.
    most = 2000
    heavy = F.broadcast(again.filter((F.col("n") * most > F.lit(picks or 0)) & F.col("anchor").isNotNull()).select("anchor"))
    every = own.mapInArrow(occurrences, OCCURRENCE).join(heavy.withColumn("heavy", F.lit(True)), "anchor", "left")
    # Light ones meet the recurring phrases at their key; heavy ones are known to recur and go anywhere.
    at = F.when(F.col("heavy"), F.xxhash64("row_key", "start")).otherwise(F.col("anchor"))
    light = again.filter(F.col("anchor").isNotNull()).select(F.col("anchor").alias("phrase"), F.col("anchor").alias("at"))
    found = every.withColumn("at", at).join(light, "at", "left").filter("heavy or phrase = anchor").drop("at", "heavy", "phrase")
    found = cut(found, "occurrences", free=True)
    one = F.min(F.struct("row_key", "start", "windows")).alias("one")
    return found, cut(found.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), one), "stretches"), shards


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of WINDOW: each window of the stretches asked for in `parts`."""
    names = [x.split()[0] for x in WINDOW.split(", ")]
    for batch in by_bytes(batches, "text", 2 << 20):
        out: list[list[np.ndarray]] = [[] for _ in names]
        for text, key, parts in zip(as_bytes(batch.column("text")), batch.column("row_key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            spans = Spans(word_hashes(text.split()))
            anchor, start, windows, n = (np.array([p[c] for p in parts], dtype=np.int64) for c in ("anchor", "start", "windows", "n"))
            at = np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            made = (np.repeat(anchor, windows), spans.of(at, at + width).view(np.int64), np.repeat(n, windows), np.full(len(at), key), at.astype(np.int32))
            for x, y in zip(out, made, strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)


def joined(starts: list[int], width: int) -> list[tuple[int, int]]:
    """First and last word of each passage made of windows that begin at `starts`, of neighbouring ones together."""
    out: list[list[int]] = []
    for start in sorted(starts):
        if out and start <= out[-1][1] + 1:
            out[-1][1] = start
        else:
            out.append([start, start])
    return [(a, b + width) for a, b in out]


def _passages(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of PASSAGE: runs of words that recurring windows cover, as one sequence, with the spans that recur as
    they stand and the keys of the stretches that hold them. parts: stretches with the windows that recur."""
    for batch in by_bytes(batches, "text", 2 << 20):
        rows = []
        for text, row_key, parts in zip(as_bytes(batch.column("text")), batch.column("row_key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            words = text.split()
            spans = sorted((a, b, p["anchor"], p["stretch"]) for p in parts for a, b in joined(p["starts"], width))
            edges = [i for i, x in enumerate(spans) if not i or x[0] >= spans[i - 1][1]]
            for i, j in zip(edges, [*edges[1:], len(spans)], strict=True):
                low, high = spans[i][0], max(x[1] for x in spans[i:j])
                own = sorted({(a - low, b - low) for a, b, _, _ in spans[i:j]})
                keys = {x[2:] for x in spans[i:j]}
                number = xxhash.xxh64_intdigest(b"%d %d" % (row_key, low)) >> 1
                rows.append((number, b" ".join(words[low:high]), np.array(own, dtype="<i4").tobytes(), [{"anchor": a, "stretch": b} for a, b in keys]))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("anchor", pa.int64()), ("stretch", pa.int64())])))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["passage", "words", "spans", "keys"])


def confirmed_passages(own: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """PASSAGE, of what occurs twice or more."""
    once = own.dropDuplicates(["row_key"])  # rows that repeat in full would answer twice
    mixed = cut(stretches.groupBy("anchor").agg(F.min("n").alias("least")).filter("least = 1").select("anchor"), "mixed-phrases")
    asked = stretches.join(mixed, "anchor", "left_semi")
    asked = asked.groupBy(F.col("one.row_key").alias("row_key")).agg(F.collect_list(F.struct("anchor", "n", "one.start", "one.windows")).alias("parts"))
    windows = cut(once.join(asked, "row_key").mapInArrow(lambda x: _windows(x, width), WINDOW), "windows", free=True)
    known = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "window")
    single = windows.filter("n = 1").join(known, ["anchor", "window"], "left_semi").select("anchor", "row_key", "start")

    # A lone stretch has one place, so its windows are those of its phrase there; it may be picked once more in the same text.
    lone = stretches.filter("n = 1").select("anchor", "stretch", "one.row_key", F.col("one.start").alias("first"), "one.windows")
    lone = lone.join(single, ["anchor", "row_key"]).filter("start >= first and start < first + windows")
    lone = lone.groupBy("row_key", "anchor", "stretch").agg(F.collect_set("start").alias("starts"))
    whole = stretches.filter("n > 1").select("one.row_key", "anchor", "stretch", F.expr("sequence(one.start, one.start + one.windows - 1)").alias("starts"))
    parts = lone.unionByName(whole).groupBy("row_key").agg(F.collect_list(F.struct("anchor", "stretch", "starts")).alias("parts"))
    return cut(once.join(parts, "row_key").mapInArrow(lambda x: _passages(x, width), PASSAGE), "passages", free=True)


class Shard:
    """The automaton of a shard's passages, over the words that they hold."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.made = False

    def add(self, words: bytes, spans: bytes) -> None:
        """A passage, and first and last word of what recurs in it as it stands (32-bit numbers)."""
        code = tuple([self.ids.setdefault(w, len(self.ids) + 1) for w in words.split(b" ")])
        for a, b in np.frombuffer(spans, dtype="<i4").reshape(-1, 2).tolist():
            self.machine.add_word(code[a:b])

    def located(self, words: list[bytes]) -> np.ndarray:
        """Which of a document's words lie in an occurrence of a passage."""
        if not self.ids:
            return np.zeros(len(words), dtype=bool)
        if not self.made:
            self.machine.make_automaton()
            self.made = True
        known = self.ids.get
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for last, length in self.machine.iter(tuple([known(w, 0) for w in words])):
            edge[last - length + 1] += 1
            edge[last + 1] -= 1
        return np.cumsum(edge)[:-1] > 0


def _streamed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of shards, and in each its passages before its documents: the documents, cut."""
    kind = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))])
    at, shard = None, Shard()
    for batch in by_bytes(batches, ("text", "words"), 1 << 20):
        documents = []
        columns = (*(batch.column(c).to_pylist() for c in ("shard", "words", "spans")), as_bytes(batch.column("text")))
        for i, (number, passage, spans, text) in enumerate(zip(*columns, strict=True)):
            if number != at:
                at, shard = number, Shard()
            if passage is not None:
                shard.add(passage, spans)
                continue
            words = text.split()
            documents.append((i, _row(text, words, shard.located(words), with_text)))
        if documents:
            some = batch.take(pa.array([i for i, _ in documents]))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("text"), pa.array([x for _, x in documents], kind)], ["row", "text", "made"])


def _row(text: bytes, words: list[bytes], gone: np.ndarray, with_text: bool) -> dict:
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
    shown = None
    if with_text:
        shown = text
        if len(kept) < len(words):
            shown = b"".join(m[0] for m, g in zip(TOKEN.finditer(text), gone.tolist(), strict=True) if not g).strip()
        shown = shown.decode()
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    spans = [{"start": int(a), "words": int(b - a)} for a, b in edge.reshape(-1, 2)]
    return {"text": shown, "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "spans": spans}


def cut_passages(docs: DataFrame, width: int = 35, gram: int = 11, with_text: bool = True, shard_bytes: int = 1 << 20) -> DataFrame:
    """(row, text, made) for every row of docs: its other columns as a struct, its text, and a struct of CUT:
    the text without its recurring passages (a text that has none is as it was), counts of words, the digest
    of the kept words and the spans removed."""
    others = [c for c in docs.columns if c != "text"]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and not isinstance(f.dataType, ArrayType | MapType | StructType | VariantType)]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")), *plain).bitwiseAND((1 << 63) - 1)
    rows = docs.select(row.alias("row"), text.alias("text"), key.alias("row_key"))
    own = rows.select("row_key", "text")
    found, stretches, shards = recurring_stretches(own, width, gram, shard_bytes)
    passages = confirmed_passages(own, stretches, width)
    keys = passages.select("passage", F.explode("keys").alias("k")).select("passage", "k.anchor", "k.stretch")
    sent = found.select("anchor", "stretch", "shard").distinct().join(keys, ["anchor", "stretch"]).select("passage", "shard").distinct()
    sent = sent.join(passages.select("passage", "words", "spans"), "passage")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in (*sent.schema, *rows.schema)}
    dealt = rows.select((F.col("row_key") % shards).alias("shard"), none["words"], none["spans"], "row", "text")
    dealt = dealt.unionByName(sent.select("shard", "words", "spans", none["row"], none["text"]))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.col("words").isNull())
    schema = StructType([rows.schema["row"], rows.schema["text"], StructField("made", StructType.fromDDL(CUT))])
    return ordered.mapInArrow(lambda x: _streamed(x, with_text), schema)


def remove_passages(docs: DataFrame, width: int = 35, gram: int = 11) -> DataFrame:
    """Every row and column of docs, with `text` less its recurring passages, and `n_chars`, if it is there, as
    the length of a text that has changed."""
    made = cut_passages(docs, width, gram)
    text = F.when(F.col("made.n_removed") > 0, F.col("made.text")).otherwise(F.col("text"))
    length = {f.name: F.length(text).cast(f.dataType) for f in docs.schema if f.name == "n_chars"}

    def column(c: str):
        if c == "text":
            return text.cast(docs.schema["text"].dataType).alias(c)
        own = F.col(f"row.`{c}`")
        return (F.when(F.col("made.n_removed") > 0, length[c]).otherwise(own) if c in length else own).alias(c)

    return made.select(*[column(c) for c in docs.columns])


def op7_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut_passages(texts(table(spark, sf_dir, "documents")), with_text=False)
    return made.select("row.doc_id", "made.n_words", "made.n_removed", "made.kept_sha256")
