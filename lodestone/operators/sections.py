"""Chunks of structured documents, section by section (DOC-3, UDF-7).

No chunk crosses a heading, so the pieces under one heading are filled into chunks by themselves: a task streams the
pieces of its sections in order and holds no more than the chunk before, the one at hand and a paragraph that may
lead into a list. A document of any length is as many sections as it has headings; heading paths and the chunks'
numbers in the document come from running values.

What fills a chunk: paragraphs up to the target; one longer than the most is cut at sentences. A list stays whole
with the paragraph before it that ends in a colon, if both have room, else its items fill chunks that repeat that
paragraph as lead_in. A table is by itself, its rows fill chunks that repeat the first row as lead_in. A chunk of
prose begins with up to two of the last sentences of the prose before it, within a share of the target.

Defined cases: pieces of white space alone give no chunk; a sentence or an item longer than the target is a chunk by
itself, whole. Lengths and offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.python import sentence_spans
from lodestone.operators.ordered import carried
from lodestone.operators.structure import heading_paths

FILLED = "page long, line long, kind string, text string, lead_in string, page_start long, page_end long, char_start long, char_end long, overlap_chars long"


@dataclass(frozen=True)
class Room:
    """How much goes into a chunk (fixed values: the defaults)."""

    target: int = 1600
    most: int = 3200
    sentences: int = 2
    share: float = 0.15


@dataclass
class Draft:
    start: int
    end: int
    kind: str
    overlap: int = 0
    lead: str | None = None
    prose: bool = False


class Section:
    """Fills chunks with a section's pieces, given in order."""

    def __init__(self, room: Room):
        self.room, self.out = room, []
        self.text, self.base = "", 0  # the document's text from base on, as far as pieces have come
        self.spans: list[tuple[int, int]] = []  # (start, page) of pages' parts
        self.now: Draft | None = None
        self.before: Draft | None = None
        self.lead: dict | None = None  # a paragraph that leads into a list, if one comes
        self.packs: str | None = None  # lead_in of the list or table whose pieces are being packed
        self.packing = self.own = False  # own: the chunk at hand is over when its block is

    # Text.
    def _slice(self, start: int, end: int) -> str:
        return self.text[start - self.base : end - self.base]

    def _page(self, at: int) -> int:
        return [page for start, page in self.spans if start <= at][-1]

    def _see(self, piece: dict) -> None:
        if not self.text:
            self.base = piece["start"]
        self.text += "\n" * (piece["start"] - self.base - len(self.text)) + piece["text"]
        self.spans += [(s["start"], s["page"]) for s in piece["spans"] if s["end"] > s["start"]]

    def _forget(self) -> None:
        held = [x.start for x in (self.before, self.now) if x] + ([self.lead["start"]] if self.lead else [])
        first = min(held, default=self.base + len(self.text))
        self.text, self.base = self.text[first - self.base :], first
        old = [i for i, (start, _) in enumerate(self.spans) if start <= first]
        self.spans = self.spans[old[-1] if old else 0 :]

    # Drafts.
    def _close(self) -> None:
        if self.now:
            x, text = self.now, self._slice(self.now.start, self.now.end)
            if text.strip():
                self.out.append((x.kind, text, x.lead, self._page(x.start), self._page(x.end - 1), x.start, x.end, x.overlap))
            self.before, self.now = x, None

    def _prose(self, start: int, end: int) -> None:
        """Opens a draft of prose, with the last sentences of the prose before it."""
        again, old = start, self.before
        if old and old.prose:
            tail = [old.start + a for a, _ in sentence_spans(self._slice(old.start, old.end))][-self.room.sentences :]
            least = max(old.end - self.room.target * self.room.share, old.start + old.overlap)
            fits = [a for a in tail if a >= least]
            again = fits[0] if fits else start
        self.now = Draft(again, end, "prose", overlap=start - again, prose=True)

    def _has_room(self, length: int) -> bool:
        return self.now is not None and self.now.end - self.now.start + 2 + length <= self.room.target

    def _paragraph(self, start: int, end: int) -> None:
        if end - start > self.room.most:
            self._close()
            first = last = None
            for a, b in [*sentence_spans(self._slice(start, end)), (None, None)]:
                if first is not None and (a is None or b - first > self.room.target):
                    self._prose(start + first, start + last)
                    self._close()
                    first = None
                first, last = a if first is None else first, b
        elif self._has_room(end - start):
            self.now.end, self.now.prose = end, True
        else:
            self._close()
            self._prose(start, end)

    def _pack(self, start: int, end: int, kind: str) -> None:
        """An item or row: into the chunk at hand, or a new one that repeats the lead."""
        if self.now and end - self.now.start <= self.room.target:
            self.now.end = end
        elif self.now:
            self._close()
            self.now = Draft(start, end, kind, lead=self.packs)
        else:
            self.now = Draft(start, end, kind)

    def _list(self, piece: dict, lead: dict | None) -> None:
        start = lead["start"] if lead else piece["start"]
        length = piece["block_end"] - start
        if self._has_room(length):
            self.now.end, self.now.kind, self.now.prose = piece["block_end"], "list", False
            return
        self._close()
        self.own = True
        if length <= self.room.most:
            self.now = Draft(start, piece["block_end"], "list")
        else:
            self.packs, self.packing = lead["text"] if lead else None, True
            self._pack(start, piece["end"], "list")

    def _lead_alone(self) -> None:
        if self.lead:
            lead, self.lead = self.lead, None
            self._paragraph(lead["start"], lead["end"])

    def add(self, piece: dict) -> None:
        if piece["opens"]:
            if self.own:
                self._close()
            self.own = self.packing = False
            if piece["kind"] != "list":
                self._lead_alone()
        self._see(piece)
        if piece["kind"] == "paragraph":
            if piece["text"].rstrip().endswith(":"):
                self.lead = piece
            else:
                self._paragraph(piece["start"], piece["end"])
        elif piece["kind"] == "table" and piece["opens"]:
            self._close()
            self.own = self.packing = True
            self.packs = piece["text"]
            self._pack(piece["start"], piece["end"], "table")
        elif piece["opens"]:
            lead, self.lead = self.lead, None
            self._list(piece, lead)
        elif self.packing:
            self._pack(piece["start"], piece["end"], piece["kind"])
        self._forget()

    def done(self) -> list[tuple]:
        """The chunks that are complete since the last time, and all others."""
        self._lead_alone()
        self._close()
        return self.taken()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def filled(pieces: DataFrame, room: Room = Room()) -> DataFrame:
    """Chunks (doc and FILLED) of a structured document's pieces; page and line are those of the heading above, or null."""
    kind = pieces.schema["doc"].dataType
    names = ["doc", *[x.split()[0] for x in FILLED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, section, rows = None, None, []
        for batch in batches:
            for piece in batch.to_pylist():
                own = (piece["doc"], piece["page"], piece["line"])
                if own != key or section is None:
                    if section:
                        rows += [(*key, *x) for x in section.done()]
                    key, section = own, Section(room)
                section.add(piece)
                rows += [(*key, *x) for x in section.taken()]
            if rows:
                yield _batch(rows)
                rows = []
        if section:
            rows = [(*key, *x) for x in section.done()]
        if rows:
            yield _batch(rows)

    arrow = [None, *[{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in FILLED.split(", ")]]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, k) if k else pa.array(x) for x, k in zip(zip(*rows, strict=True), arrow, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    under = pieces.filter("kind <> 'heading'").select(
        "doc", F.col("heading.page").cast("long").alias("page"), F.col("heading.line").cast("long").alias("line"), "kind", "text", "start", "end", "spans", "opens", "block_end"
    )
    ordered = under.repartition("doc", "page", "line").sortWithinPartitions("doc", "page", "line", "start")
    return ordered.mapInArrow(run, f"doc {kind.simpleString()}, {FILLED}")


def section_chunks(pieces: DataFrame, room: Room = Room()) -> DataFrame:
    """All chunks of the documents whose pieces are given, with their number, heading path and section number."""
    made = filled(pieces, room)
    heads = heading_paths(pieces).select(
        F.col("doc").alias("_doc"), F.col("heading.page").cast("long").alias("_page"), F.col("heading.line").cast("long").alias("_line"),
        F.col("path").alias("heading_path"), F.try_element_at(F.filter("numbers", lambda x: x.isNotNull()), F.lit(-1)).alias("section_number"),
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("line") == F.col("_line"))
    made = made.join(heads, same, "left").drop("_doc", "_page", "_line", "page", "line")
    made = carried(made.withColumn("one", F.lit(1).cast("long")), ["doc"], ["char_start", "char_end"], sums=["one"])
    text = F.col("text")
    return made.select(
        "doc", F.col("before_one").alias("chunk_index"), "kind", "text", "lead_in", F.try_element_at("heading_path", F.lit(-1)).alias("heading"),
        F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), "section_number", "page_start", "page_end", "char_start", "char_end", "overlap_chars",
        F.sha2("text", 256).alias("content_hash"), F.length(text).alias("char_count"), F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).alias("token_estimate"),
    )
