"""Lines of web pages with the size, weight and place that their tags give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import squeezed

#: Points by tag; all others have 10.
SIZES = {"h1": 16.0, "h2": 14.0, "h3": 13.0, "h4": 12.0, "h5": 11.5, "h6": 11.5}
BREAKS = "h[1-6]|p|div|section|article|header|footer|nav|aside|ul|ol|li|table|tr|br|b|main|form|blockquote"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def html_lines(pages: DataFrame, doc: str, page: str, html: str = "html") -> DataFrame:
    """(doc, page, line, text, size, bold, x, y, runs) for pages of documents, all in the JVM.

    A tag of BREAKS, open or closed, begins a line; headings have their size, <b> its weight, list items a mark and an
    indent, cells are runs in columns of 100 points. A line lies 14 points below the one before it, 24 where it begins
    with another tag than <br>. Scripts, styles, comments and heads have no lines; a null page has none."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    marked = F.regexp_replace(bare, rf"(?i)<(/?(?:{BREAKS}))\b[^>]*>", "\u0001$1\u0002")
    marked = F.regexp_replace(F.regexp_replace(marked, r"(?i)<(?:td|th)\b[^>]*>", "\u0003"), r"<[^>]*>", "")
    for entity, sign in ENTITIES.items():
        marked = F.replace(marked, F.lit(entity), F.lit(sign))
    parts = F.transform(F.split(marked, "\u0001"), lambda x: F.struct(F.lower(F.try_element_at(F.split(x, "\u0002"), F.lit(1))).alias("tag"), F.try_element_at(F.split(x, "\u0002"), F.lit(-1)).alias("text")))
    cells = F.transform(parts, lambda x: F.struct(x["tag"].alias("tag"), F.filter(F.transform(F.split(x["text"], "\u0003"), squeezed), lambda c: c != "").alias("cells")))
    full = F.filter(cells, lambda x: F.size(x["cells"]) > 0)
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(full).alias("line", "x"))
    tag = F.col("x.tag")
    size = F.lit(10.0)
    for name, points in SIZES.items():
        size = F.when(tag == name, points).otherwise(size)
    text = F.array_join("x.cells", " ")
    runs = F.transform("x.cells", lambda c, i: F.struct(c.alias("text"), (i * 100.0).alias("x")))
    order = Window.partitionBy("doc", "page").orderBy("line")
    y = -F.sum(F.when(tag == "br", 14.0).otherwise(24.0)).over(order)
    return lines.select(
        "doc", "page", "line", F.when(tag == "li", F.concat(F.lit("• "), text)).otherwise(text).alias("text"), size.alias("size"),
        (tag.rlike("^h[1-6]$") | (tag == "b")).alias("bold"), F.when(tag == "li", 10.0).otherwise(0.0).alias("x"), y.alias("y"), runs.alias("runs"),
    )
