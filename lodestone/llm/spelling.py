"""Spelling variant grouping: a symmetric-delete join.

Every word gives its own key and the keys of its distinct single deletions. Two words differ by one inserted or
deleted code point if one is a deletion of the other; they differ by one replaced code point if both have the same
deletion at the same place. So words that share a key are joined, each pair once, and the exact distance is verified
on the words themselves. A key is a 64-bit number that is worked out for all deletions of a word in one go, from
both its ends, so that a word of any length sends as many short rows as it has letters.

Equal letters in a row make equal deletions, which are given once, with the first and last place; two deletions
are of the same place if these overlap. A key belongs to few words: those that have one letter more than the same
string, at any of its places.

A word's form is its near word of largest count where that is at least ten times its own; roots are found by following
forms, twice as far in every join. Counts grow tenfold with each form, so a handful of joins suffices.

Defined cases: a null text has no words, a null id counts as an empty one. Repeated rows count as often as they
occur. Texts are read in parts of bounded size, a word of any length whole. Of near words with equal counts the
smallest in code-point order is the form. Other columns are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, table, texts

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
REST = re.compile(LETTERS + "*")
LOWER = {c: c + 32 for c in range(65, 91)}
PRIME, BASE = (1 << 61) - 1, 0x2545F4914F6CDD1D % ((1 << 61) - 1)
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000


def runs(text: str, pattern: re.Pattern, step: int = 1 << 20) -> Iterator[Counter]:
    """Counts of the runs of letters that pattern finds, for parts of about `step` characters that end with a run."""
    start = 0
    while start < len(text):
        stop = REST.match(text, min(start + step, len(text))).end()
        yield Counter(pattern.findall(text, start, stop))
        start = stop


def spelled(doc_id: str, run: str, every: int) -> str:
    """The run with A to Z in lower case, and without one code point where `every` divides the checksum of id and run."""
    run = run if run.islower() else run.translate(LOWER)
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = 7, fewest: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of the words of all docs (doc_id, text) with at least `shortest` code points and `fewest` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        pattern = re.compile(f"{LETTERS}{{{shortest},}}")

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in by_bytes(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = "" if doc_id is None else str(doc_id)
                for counts in runs(text or "", pattern):
                    for found, n in counts.items():
                        word = spelled(name, found, every)
                        if len(word) >= shortest:
                            held[word] += n
                    if len(held) >= HELD:
                        yield told()
        yield told()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def deletions(word: str) -> list[tuple[int, int, int]]:
    """(key, first, last) of the distinct single deletions: from first to last the word's letters are equal."""
    n = len(word)
    after, power = [0] * (n + 1), [1] * (n + 1)  # of the letters from i on; BASE**i
    for i in range(n - 1, -1, -1):
        after[i] = (after[i + 1] + (ord(word[i]) + 1) * power[n - 1 - i]) % PRIME
        power[n - i] = power[n - 1 - i] * BASE % PRIME
    made, before, i = [], 0, 0  # before: of the letters up to i, as if the word ended there
    while i < n:
        j = i
        while j + 1 < n and word[j + 1] == word[i]:
            j += 1
        made.append(((before * power[n - 1 - i] + after[i + 1]) % PRIME, i, j))
        for _ in range(i, j + 1):
            before = (before * BASE + ord(word[i]) + 1) % PRIME
        i = j + 1
    return made


def own_key(word: str) -> int:
    made = 0
    for c in word:
        made = (made * BASE + ord(c) + 1) % PRIME
    return made


def delete_keys(words: DataFrame) -> DataFrame:
    """(key, id, first, last) of words (id, word): first and last are -1 for the word's own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "word", 1 << 16):
            rows = []
            for number, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                rows.append((own_key(word), number, -1, -1))
                rows.extend((key, number, first, last) for key, first, last in deletions(word))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["key", "id", "first", "last"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, first int, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), each pair of words (id, word) once whose distance is exactly one inserted, deleted or replaced code point.
    words: a stored table."""
    keys = delete_keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    replaced = (F.col("a.first") >= 0) & (F.col("b.first") >= 0) & (F.col("a.id") < F.col("b.id"))
    replaced = replaced & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    inserted = (F.col("a.first") < 0) & (F.col("b.first") >= 0)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (replaced | inserted)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    for end in ("a", "b"):
        pairs = pairs.join(words.select(F.col("id").alias(end), F.col("word").alias(f"{end}_word")), end)
    return pairs.filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """(id, root): for each row of links (id, form), an acyclic table with one row for each id, where following forms ends."""
    far = cut(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = far.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut(far.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        far = moved.select("id", "root")
        if not moved.filter("moved").limit(1).count():
            return far


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n): n_near counts the near words; form is the near word
    of largest n where that is at least `times` the word's n, else null; root is where forms lead, or the word itself."""
    numbered = cut(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = cut(near_pairs(numbered), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(numbered.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form", "b")).alias("best")
    near = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    known = numbered.join(near, "id", "left").withColumn("has", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    known = cut(
        known.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            *[F.when(F.col("has"), x).alias(name) for x, name in ((F.col("best.b"), "form_id"), (F.col("best.form"), "form"), (-F.col("best.less"), "form_n"))],
        ),
        "forms",
    )
    ends = roots(known.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    ends = ends.join(numbered.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_symmetric_delete_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))
