"""Structure of paged documents: headings with levels, paragraphs, lists and tables, and the places of pages in the
normalised text (DOC-2).

Lines come with page, number, size, weight and place. What a line is follows from its own text and from the size
that most of the document's letters have, an aggregate. Which block a line belongs to follows from the line before
it: within a page by windows, from page to page by one row for each page. Offsets are running sums. A document
may have any number of pages; nothing holds more than a page or a block.

The normalised text of a document is its blocks parted by a blank line, with items and rows on lines of their own.
A piece is a heading, a paragraph, an item or a row. Lengths and offsets count code points.

Defined cases: lines without text or with a null one are left out; null size, weight, x, y or runs count as 10, not
bold, 0, 0 and none. A document without lines has no blocks, and its pages are empty spans. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import carried
from lodestone.sources.tables import cut

#: How numbered sections and items of lists begin, and the number in front.
NUMBERED = r"^(?:§\s*\d+[a-zA-Z]?|\d+(?:\.\d+)+\.?)\s+\S"
MARKED = r"^(?:[•▪◦·∙‣\-–—*]|\(?[a-zæøå]\)|\(?\d{1,2}\)|[a-zæøå]\.|\d{1,2}\.)\s+\S"
LEADING_NUMBER = r"^(?:§\s*)?(\d+(?:\.\d+)*)"
#: Factors and limits of size, length and distance.
LARGER, LONGEST, LONGEST_NUMBERED, NEXT_LINE, NEXT_ITEM, INDENT = 1.15, 150, 80, 1.9, 2.5, 3


@dataclass
class Structured:
    """pieces: doc, page, line (of the first line), block, kind, level, section_number, text, start, end, spans (start, end and
    page of its parts), opens (first of its block), block_end, heading (page and line of the heading it is under);
    pages: doc, page, has_text, start, end; tables: doc, block, uncertain."""

    pieces: DataFrame
    pages: DataFrame
    tables: DataFrame


def number_of(text: Column) -> Column:
    """The number of a section heading, or null."""
    numbered = text.rlike(NUMBERED) | text.rlike(r"^§\s*\d")
    return F.when(numbered, F.regexp_extract(text, LEADING_NUMBER, 1))


def wrapped(lines: Column) -> Column:
    """Lines as one text: a hyphen between a letter and a small letter on the next line goes, others meet at a space."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"([A-Za-zÆØÅæøå])-\n(?=[a-zæøå])", "$1"), "\n", " ")


def classified(lines: DataFrame) -> DataFrame:
    """lines with half (the size in halves), kind, number (of a section) and depth (of its numbering)."""
    lines = lines.select(
        "doc", "page", "line", "text",
        F.coalesce("size", F.lit(10.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"),
        F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"),
        F.coalesce("runs", F.array().cast("array<struct<text:string,x:double>>")).alias("runs"),
    ).filter(F.length("text") > 0)
    lines = lines.withColumn("half", F.floor(F.col("size") * 2 + 0.5) / 2)
    weights = lines.groupBy("doc", "half").agg(F.sum(F.length("text")).alias("letters"), F.min(F.struct("page", "line")).alias("first"))
    body = weights.groupBy("doc").agg(F.min(F.struct((-F.col("letters")).alias("less"), "first", "half"))["half"].alias("body"))
    text = F.col("text")
    ended, length = text.rlike(r"[.,;:]\z"), F.length("text")
    numbered = text.rlike(NUMBERED) & (length <= LONGEST_NUMBERED) & ~ended
    heading = (length <= LONGEST) & ~text.endswith(":") & ((F.col("size") >= F.col("body") * LARGER) | (F.col("bold") & ~ended) | numbered)
    kind = F.when(F.size("runs") >= 2, "table").when(heading, "heading").when(text.rlike(MARKED), "list").otherwise("body")
    page = Window.partitionBy("doc", "page").orderBy("line")
    made = lines.join(body, "doc").withColumn("kind", kind)
    beside = (F.lag("kind").over(page) == "table") | (F.lead("kind").over(page) == "table")
    alone = (F.col("kind") == "table") & ~F.coalesce(beside, F.lag("kind").over(page) == "table", F.lead("kind").over(page) == "table", F.lit(False))
    made = made.withColumn("kind", F.when(alone, "body").otherwise(F.col("kind"))).withColumn("number", number_of(text))
    return made.withColumn("depth", F.size(F.filter(F.split(F.regexp_extract("text", LEADING_NUMBER, 1), r"\."), lambda x: x != "")))


def levels(lines: DataFrame) -> DataFrame:
    """(doc, half, depth, level) of the headings among classified lines: by size, then by depth. One row for each kind
    of heading, not for each heading."""
    kinds = lines.filter("kind = 'heading'").select("doc", "half", "depth").distinct()
    size = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("half"))) - 1
    key = Window.partitionBy("doc").orderBy(F.col("key"))
    return kinds.withColumn("key", size * 10 + F.col("depth")).select("doc", "half", "depth", F.dense_rank().over(key).alias("level"))


def _listed(lines: DataFrame) -> DataFrame:
    """Whether a line is of a list (its item's line is `item`), and whether a heading goes on with the one before."""
    page = Window.partitionBy("doc", "page").orderBy("line")

    def old(x: str) -> Column:
        return F.lag(x).over(page)

    is_list, is_body, is_heading = (F.col("kind") == x for x in ("list", "body", "heading"))
    alike = (old("kind") == "heading") & (old("half") == F.col("half")) & (old("bold") == F.col("bold")) & ~F.col("text").rlike(NUMBERED)
    below = old("y") - F.col("y") <= old("size") * NEXT_LINE
    marked = F.last(F.when(is_list, F.struct("line", "x")), True).over(page)
    lines = lines.withColumns({
        "fresh": is_heading & ~F.coalesce(alike, F.lit(False)), "item": marked["line"],
        "fits": is_list | F.coalesce(is_body & (F.col("x") > marked["x"] + INDENT) & below, F.lit(False)),
    })
    lines = lines.withColumns({"run": F.sum(F.col("fresh").cast("int")).over(page), "list": F.sum(is_list.cast("int")).over(page)})
    earlier = Window.partitionBy("doc", "page", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc", "page", "list").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.coalesce(F.max(F.col("number").isNull()).over(earlier), F.lit(False))
    return lines.withColumns({"goes_on": is_heading & ~F.col("fresh") & plain, "listed": F.min("fits").over(so_far)}).drop("fresh", "run", "list", "fits")


def _linked(lines: DataFrame) -> DataFrame:
    """Lines with `opens`: whether they open a block, given the line before, on whatever page."""
    page = Window.partitionBy("doc", "page").orderBy("line")
    state = F.struct("kind", "listed", "text", "size", "y", "page")
    tails = lines.groupBy("doc", "page").agg(F.max_by(state, F.col("line")).alias("tail"))
    before = carried(tails, ["doc"], ["page"], last=["tail"]).select("doc", "page", "prev_tail")
    lines = lines.join(before, ["doc", "page"]).withColumn("old", F.coalesce(F.lag(state).over(page), F.col("prev_tail")))
    old, same = F.col("old"), F.col("old.page") == F.col("page")
    drop = old["y"] - F.col("y")
    apart = F.when(~same, old["text"].rlike(r"[.!?:]\z") | ~F.col("text").rlike("^[a-zæøå]")).otherwise((F.abs(F.col("size") - old["size"]) > 1) | (drop > old["size"] * NEXT_LINE))
    joins = (
        F.when(F.col("kind") == "heading", F.col("goes_on"))
        .when(F.col("kind") == "table", old["kind"] == "table")
        .when(F.col("kind") == "list", old["listed"] & ~(same & (drop > old["size"] * NEXT_ITEM)))
        .otherwise(F.col("listed") | ((old["kind"] == "body") & ~old["listed"] & ~apart))
    )
    return lines.withColumn("opens", ~F.coalesce(joins, F.lit(False))).drop("old", "prev_tail", "goes_on")


def _spans(lines: Column) -> Column:
    """Parts of a piece by page, as (page, letters) in order."""
    pages = F.array_distinct(F.transform(lines, lambda x: x["page"]))
    return F.transform(pages, lambda p: F.struct(p.alias("page"), F.aggregate(F.filter(lines, lambda x: x["page"] == p), F.lit(0), lambda s, x: s + F.length(x["text"]) + 1).alias("letters")))


def _pieces(lines: DataFrame) -> DataFrame:
    page = Window.partitionBy("doc", "page").orderBy("line")
    at = F.struct("page", "line")
    first = F.last(F.when(F.col("opens"), at), True).over(page)
    open_at = lines.groupBy("doc", "page").agg(F.max(F.when(F.col("opens"), at)).alias("open"))
    open_at = carried(open_at, ["doc"], ["page"], last=["open"]).select("doc", "page", "prev_open")
    lines = lines.join(open_at, ["doc", "page"]).withColumn("block", F.coalesce(first, F.col("prev_open")))
    single = F.col("kind").isin("list", "table")
    piece = F.when(single, at).when(F.col("listed"), F.struct("page", F.col("item").alias("line"))).otherwise(F.col("block"))
    lines = lines.withColumn("piece", piece)
    held = F.struct("page", "line", F.when(F.col("kind") == "table", F.array_join("runs.text", " | ")).otherwise(F.col("text")).alias("text"))
    kind = F.when(F.col("listed"), "list").when(F.col("kind") == "body", "paragraph").otherwise(F.col("kind"))
    made = lines.groupBy("doc", "block", "piece").agg(
        F.array_sort(F.collect_list(held)).alias("lines"), F.min_by(kind, at).alias("kind"), F.min_by("half", at).alias("half"), F.min_by("depth", at).alias("depth")
    )
    made = made.withColumns({"text": wrapped(F.col("lines.text")), "shares": _spans(F.col("lines")), "opens": F.col("piece") == F.col("block")})
    return made.select("doc", F.col("piece.page").alias("page"), F.col("piece.line").alias("line"), "block", "kind", "half", "depth", "text", "shares", "opens")


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with their block's number, offsets, the heading they are under and the parts of pages."""
    gap = F.when(F.col("opens"), 2).otherwise(1)
    pieces = pieces.withColumns({
        "gap": gap, "step": (F.length("text") + gap).cast("bigint"), "one": F.col("opens").cast("bigint"),
        "under": F.when(F.col("kind") == "heading", F.struct("page", "line")),
    })
    made = carried(pieces, ["doc"], ["page", "line"], sums=["step", "one"], last=["under"])
    made = made.withColumn("start", F.col("before_step") + F.col("gap") - 2).withColumn("end", F.col("start") + F.length("text"))
    total = F.aggregate("shares", F.lit(0), lambda s, x: s + x["letters"])
    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,page:bigint>>").alias("done"))

    def part(state: Column, share: Column) -> Column:
        stop = F.least(F.col("end"), state["at"] + F.floor((F.col("end") - F.col("start")) * share["letters"] / total + 0.5))
        stop = F.when(share["page"] == F.try_element_at("shares", F.lit(-1))["page"], F.col("end")).otherwise(stop)
        return F.struct(stop.alias("at"), F.concat(state["done"], F.array(F.struct(state["at"].alias("start"), stop.alias("end"), share["page"].cast("bigint").alias("page")))).alias("done"))

    spans = F.aggregate("shares", begin, part, lambda s: s["done"])
    number = F.col("before_one") + F.col("one") - 1
    heading = F.coalesce("under", "prev_under")
    return made.select("doc", "page", "line", number.alias("block"), "kind", "half", "depth", "text", "start", "end", spans.alias("spans"), "opens", heading.alias("heading"))


def _uncertain(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc, block, uncertain) of tables: rows with different numbers of cells, or a cell too far from its column's first."""
    at = F.struct("page", "line")
    rows = placed.filter("kind = 'table'").select("doc", "page", "line", "block").join(lines.select("doc", "page", "line", "size", "runs"), ["doc", "page", "line"])
    cells = rows.select("doc", "block", at.alias("at"), "size", F.posexplode("runs").alias("place", "run"))
    column = cells.groupBy("doc", "block", "place").agg(
        F.min("run.x").alias("low"), F.max("run.x").alias("high"), F.count("*").alias("n"), F.min(F.struct("at", "size", "run.x")).alias("first")
    )
    off = (F.col("high") - F.col("first.x") > F.col("first.size")) | (F.col("first.x") - F.col("low") > F.col("first.size"))
    return column.groupBy("doc", "block").agg((F.max(off) | (F.min("n") != F.max("n"))).alias("uncertain"))


def structured(lines: DataFrame, pages: DataFrame | None = None) -> Structured:
    """lines: doc, page, line, text, size, bold, x, y, runs (text, x); pages: doc, page of all pages, those without text too
    (None: the pages of the lines)."""
    known = cut(classified(lines))
    linked = cut(_linked(_listed(known)))
    placed = cut(_placed(_pieces(linked)))
    size = levels(known)
    pieces = placed.join(size, ["doc", "half", "depth"], "left")
    is_heading = F.col("kind") == "heading"
    ends = Window.partitionBy("doc", "block")
    pieces = pieces.select(
        "doc", "page", "line", "block", "kind", F.when(is_heading, F.col("level")).alias("level"), F.when(is_heading, number_of(F.col("text"))).alias("section_number"),
        "text", "start", "end", "spans", "opens", F.max("end").over(ends).alias("block_end"), "heading",
    )
    parts = placed.select("doc", F.explode("spans").alias("s")).groupBy("doc", F.col("s.page").alias("page")).agg(F.min("s.start").alias("first"), F.max("s.end").alias("stop"))
    every = lines.select("doc", F.col("page").cast("bigint").alias("page")) if pages is None else pages.select("doc", F.col("page").cast("bigint").alias("page"))
    spans = carried(every.distinct().join(parts, ["doc", "page"], "left"), ["doc"], ["page"], maxima=["stop"])
    come = F.coalesce("top_stop", F.lit(0))
    start = F.when(F.col("first").isNull(), come).otherwise(F.greatest("first", come))
    spans = spans.select("doc", "page", F.col("first").isNotNull().alias("has_text"), start.alias("start"), F.greatest(start, "stop").alias("end"))
    return Structured(pieces, spans, _uncertain(linked, placed))


def heading_paths(pieces: DataFrame) -> DataFrame:
    """(doc, heading, path, numbers): for each heading the texts and section numbers of the headings it is under, itself last.

    On the way to level k lies the last heading of level k or above, if it is of level k: for each level a running
    last value, whatever the number of headings."""
    heads = pieces.filter("kind = 'heading'").select("doc", "heading", "level", "text", "section_number")
    deepest = heads.groupBy("doc").agg(F.max("level").alias("deepest"))
    each = heads.join(deepest, "doc").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("deepest"))))
    each = each.withColumn("held", F.when(F.col("level") <= F.col("k"), F.struct("level", "text", "section_number")))
    run = carried(each.select("doc", "k", "heading", "level", "text", "section_number", "held"), ["doc", "k"], ["heading"], last=["held"])
    above = F.when((F.col("k") < F.col("level")) & (F.col("prev_held.level") == F.col("k")), F.struct("k", F.col("prev_held.text").alias("text"), F.col("prev_held.section_number").alias("number")))
    own = F.when(F.col("k") == F.col("level"), F.struct("k", "text", F.col("section_number").alias("number")))
    way = F.array_sort(F.collect_list(F.coalesce(own, above)))
    return run.groupBy("doc", "heading").agg(way.alias("way")).select("doc", "heading", F.col("way.text").alias("path"), F.col("way.number").alias("numbers"))
