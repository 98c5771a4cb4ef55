"""Chunking of documents, each by itself (DOC-3).

Paragraphs are cut into sentences and filled up to a target size. A chunk that is full begins anew with up to
two of the last sentences, if they make up no more than 15 % of the target. Offsets count code points of the
document's text, and every chunk is the text between its offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.python import sentence_spans

CHUNK = "doc_id long, chunk_index int, char_start int, char_end int, overlap_chars int, text string, content_hash string"


def units(text: str, most: int) -> list[tuple[int, int]]:
    """Sentences of all paragraphs, cut where they are longer than `most`, at spaces if there are any."""
    out, at = [], 0
    for line in text.split("\n"):
        for a, b in sentence_spans(line):
            a, b = at + a, at + b
            while b - a > most:
                cut = text.rfind(" ", a + 1, a + most)
                cut = cut if cut > a else a + most
                out.append((a, cut))
                a = cut + (text[cut] == " ")
            if b > a:
                out.append((a, b))
        at += len(line) + 1
    return out


def chunk_spans(text: str, target: int = 1600, most: int = 3200) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each chunk."""
    out: list[tuple[int, int, int]] = []
    held: list[tuple[int, int]] = []
    again = 0
    for unit in units(text, most):
        if held and unit[1] - held[0][0] > (target if held[-1][1] - held[0][0] >= target // 2 else most):
            out.append((held[0][0], held[-1][1], again))
            tail = held[-2:]
            while tail and (held[-1][1] - tail[0][0] > 0.15 * target or unit[1] - tail[0][0] > most or len(tail) == len(held)):
                tail = tail[1:]
            again = held[-1][1] - tail[0][0] if tail else 0
            held = tail
        held.append(unit)
    if held:
        out.append((held[0][0], held[-1][1], again))
    return out


def chunks(docs: DataFrame, target: int = 1600, most: int = 3200) -> DataFrame:
    """Rows of CHUNK for docs (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (doc_id, i, a, b, again, text[a:b])
                for doc_id, text in zip(frame.doc_id, frame.text.fillna(""), strict=True)
                for i, (a, b, again) in enumerate(chunk_spans(text, target, most))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "char_start", "char_end", "overlap_chars", "text"])

    made = docs.select("doc_id", "text").mapInPandas(run, CHUNK.rpartition(",")[0])
    return made.withColumn("content_hash", F.sha2("text", 256))


def repeated_lines(pages: DataFrame, group: str, page: str, edge: int | None = None) -> DataFrame:
    """(group, line, pages): lines, with digits masked, on at least half of a group's pages and three (AGG-21).
    With `edge`, only the first and last so many non-empty lines of a page are held against it. Pages without
    text don't count."""
    from lodestone.functions.columns import line_key, squeezed

    lines = F.filter(F.transform(F.split("text", "\n"), squeezed), lambda x: x != "")
    full = pages.select(group, page, lines.alias("lines")).filter(F.size("lines") > 0)
    some = F.col("lines") if edge is None else F.when(F.size("lines") <= 2 * edge, F.col("lines")).otherwise(F.concat(F.slice("lines", 1, edge), F.slice("lines", -edge, edge)))
    keys = full.select(group, page, F.explode(some).alias("raw")).select(group, page, line_key("raw").alias("line")).distinct()
    count = keys.groupBy(group, "line").agg(F.count("*").alias("pages"))
    total = full.groupBy(group).agg(F.countDistinct(page).alias("n"))
    return count.join(total, group).filter("pages >= greatest(3, ceil(n / 2))").select(group, "line", "pages")
