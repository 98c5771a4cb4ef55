"""Structure and chunks of web pages: a host is a document, its pages are the document's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import six
from lodestone.operators.ordered import ranks
from lodestone.operators.sections import section_chunks
from lodestone.operators.structure import LEADING_NUMBER, MARKED, NUMBERED, Structured, classified, heading_paths, levels, structured
from lodestone.sources.html import BREAKS, ENTITIES, SIZES, html_lines
from lodestone.sources.tables import table

HOST = "^[a-z]+://([^/?#]+)"


def _lines(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", HOST, 1).alias("host"), "page_id", "html")
    return html_lines(pages, "host", "page_id")


def _structured(spark, sf) -> Structured:
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", HOST, 1).alias("doc"), F.col("page_id").alias("page"))
    return structured(_lines(spark, sf), pages)


def page_lines(spark, sf):
    """Lines with their size and kind (DOC-2, first pass)."""
    made = classified(_lines(spark, sf))
    return made.select("doc", "page", "line", F.sha2("text", 256).alias("text"), "half", "bold", "kind", "number", F.size("runs").alias("cells"))


def heading_kinds(spark, sf):
    """The level of each size and numbering depth that a host's headings have (SRT-10, WIN-8)."""
    return levels(classified(_lines(spark, sf))).select("doc", "half", "depth", "level")


def structure_blocks(spark, sf):
    """Pieces of blocks and their places (DOC-2, STR-6, STR-7)."""
    made = _structured(spark, sf).pieces
    return made.select("doc", "block", "kind", "level", "section_number", F.sha2("text", 256).alias("text"), "start", "end", "block_end")


def structure_pages(spark, sf):
    """The span of each page in its document's text (DOC-2)."""
    return _structured(spark, sf).pages


def heading_tree(spark, sf):
    """Each heading's path (DOC-3)."""
    made = heading_paths(_structured(spark, sf).pieces)
    return made.select("doc", F.col("heading.page").alias("page"), F.col("heading.line").alias("line"), F.size("path").alias("depth"), F.sha2(F.array_join("path", " > "), 256).alias("path"))


def section_chunk_rows(spark, sf):
    """Chunks that never cross a heading (DOC-3, UDF-7)."""
    made = section_chunks(_structured(spark, sf).pieces)
    return made.select(
        "doc", "chunk_index", "kind", F.sha2("lead_in", 256).alias("lead_in"), F.size("heading_path").alias("depth"), "section_number",
        "page_start", "page_end", "char_start", "char_end", "overlap_chars", "content_hash", "char_count", "token_estimate",
    )


def exact_ranks(spark, sf):
    """Nearest-rank percentiles of each type's values, of any number of values (AGG-12, AGG-13, STM-2)."""
    made = ranks(table(spark, sf, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])
    return made.select("event_type", "p", "n", six("value").alias("value"))


def _entities(text: str) -> str:
    for entity, sign in ENTITIES.items():
        quoted = sign.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return text


_ORDER = "PARTITION BY doc, page ORDER BY line"
_LINES = rf"""
bare AS (SELECT regexp_extract(url, '{HOST}', 1) AS doc, page_id AS page,
                regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', '', 'g') AS h FROM pages),
marked AS (SELECT doc, page, {_entities(rf"regexp_replace(regexp_replace(regexp_replace(h, '(?i)<(/?(?:{BREAKS}))\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '(?i)<(?:td|th)\b[^>]*>', chr(3), 'g'), '<[^>]*>', '', 'g')")} AS m FROM bare),
parts AS (SELECT doc, page, list_filter(list_transform(string_split(m, chr(1)), lambda x: struct_pack(
              tag := lower(string_split(x, chr(2))[1]),
              cells := list_filter(list_transform(string_split(string_split(x, chr(2))[-1], chr(3)), lambda c: trim(regexp_replace(c, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda c: c <> ''))),
            lambda x: len(x.cells) > 0) AS p FROM marked),
numbered AS (SELECT doc, page, unnest(range(len(p))) AS line, unnest(p) AS s FROM parts),
lines AS (SELECT doc, page, CAST(line AS INTEGER) AS line, CASE WHEN s.tag = 'li' THEN '• ' ELSE '' END || array_to_string(s.cells, ' ') AS text,
                 CASE {" ".join(f"WHEN s.tag = '{tag}' THEN {size}::DOUBLE" for tag, size in SIZES.items())} ELSE 10.0::DOUBLE END AS half,
                 regexp_matches(s.tag, '^h[1-6]$') OR s.tag = 'b' AS bold, CASE WHEN s.tag = 'li' THEN 10 ELSE 0 END AS x, s.cells AS cells,
                 -sum(CASE WHEN s.tag = 'br' THEN 14 ELSE 24 END) OVER ({_ORDER}) AS y FROM numbered),
weights AS (SELECT doc, half, sum(length(text)) AS letters, min((page, line)) AS first FROM lines GROUP BY doc, half),
bodies AS (SELECT doc, arg_min(half, (-letters, first)) AS body FROM weights GROUP BY doc),
sorted AS (SELECT l.*, CASE WHEN len(cells) >= 2 THEN 'table'
                 WHEN length(text) <= 150 AND text NOT LIKE '%:' AND (half >= body * 1.15 OR (bold AND NOT regexp_matches(text, '[.,;:]$'))
                      OR (regexp_matches(text, '{NUMBERED}') AND length(text) <= 80 AND NOT regexp_matches(text, '[.,;:]$'))) THEN 'heading'
                 WHEN regexp_matches(text, '{MARKED}') THEN 'list' ELSE 'body' END AS k FROM lines l JOIN bodies USING (doc)),
kinds AS (SELECT *, CASE WHEN k = 'table' AND coalesce(lag(k) OVER ({_ORDER}), '') <> 'table' AND coalesce(lead(k) OVER ({_ORDER}), '') <> 'table' THEN 'body' ELSE k END AS kind,
                 CASE WHEN regexp_matches(text, '{NUMBERED}') OR regexp_matches(text, '^§\s*\d') THEN regexp_extract(text, '{LEADING_NUMBER}', 1) END AS number,
                 len(list_filter(string_split(regexp_extract(text, '{LEADING_NUMBER}', 1), '.'), lambda x: x <> '')) AS depth FROM sorted)
"""
_LEVELS = """
sizes AS (SELECT doc, half, depth, dense_rank() OVER (PARTITION BY doc ORDER BY half DESC) - 1 AS n FROM (SELECT DISTINCT doc, half, depth FROM kinds WHERE kind = 'heading')),
levels AS (SELECT doc, half, depth, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY n * 10 + depth) AS INTEGER) AS level FROM sizes)
"""
_DOC = "PARTITION BY doc ORDER BY page, line"
_BLOCKS = rf"""
runs AS (SELECT *, kind = 'heading' AND NOT coalesce(lag(kind) OVER ({_ORDER}) = 'heading' AND lag(half) OVER ({_ORDER}) = half AND lag(bold) OVER ({_ORDER}) = bold
                  AND NOT regexp_matches(text, '{NUMBERED}'), false) AS fresh,
                last_value(CASE WHEN kind = 'list' THEN line END IGNORE NULLS) OVER ({_ORDER}) AS item,
                kind = 'list' OR coalesce(kind = 'body' AND x > last_value(CASE WHEN kind = 'list' THEN x END IGNORE NULLS) OVER ({_ORDER}) + 3
                                          AND lag(y) OVER ({_ORDER}) - y <= lag(half) OVER ({_ORDER}) * 1.9, false) AS fits FROM kinds),
counted AS (SELECT *, sum(fresh::INT) OVER ({_ORDER}) AS run, sum((kind = 'list')::INT) OVER ({_ORDER}) AS nth FROM runs),
listed AS (SELECT *, bool_and(fits) OVER (PARTITION BY doc, page, nth ORDER BY line) AS listed,
                  kind = 'heading' AND NOT fresh AND coalesce(bool_or(number IS NULL) OVER (PARTITION BY doc, page, run ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS goes_on
           FROM counted),
old AS (SELECT *, lag(kind) OVER w AS pk, lag(listed) OVER w AS pl, lag(text) OVER w AS pt, lag(half) OVER w AS ph, lag(y) OVER w AS py, lag(page) OVER w AS pp FROM listed WINDOW w AS ({_DOC})),
linked AS (SELECT *, NOT coalesce(CASE kind WHEN 'heading' THEN goes_on WHEN 'table' THEN pk = 'table' WHEN 'list' THEN pl AND NOT (pp = page AND py - y > ph * 2.5)
             ELSE listed OR (pk = 'body' AND NOT pl AND NOT CASE WHEN pp <> page THEN regexp_matches(pt, '[.!?:]$') OR NOT regexp_matches(text, '^[a-zæøå]')
                                                             ELSE abs(half - ph) > 1 OR py - y > ph * 1.9 END) END, false) AS opens FROM old),
held AS (SELECT *, last_value(CASE WHEN opens THEN (page, line) END IGNORE NULLS) OVER ({_DOC}) AS block FROM linked),
cut AS (SELECT *, CASE WHEN kind IN ('list', 'table') THEN (page, line) WHEN listed THEN (page, CAST(item AS INTEGER)) ELSE block END AS piece FROM held),
joined AS (SELECT doc, block, piece, arg_min(CASE WHEN listed THEN 'list' WHEN kind = 'body' THEN 'paragraph' ELSE kind END, (page, line)) AS kind,
                  arg_min(half, (page, line)) AS half, arg_min(depth, (page, line)) AS depth,
                  replace(regexp_replace(string_agg(CASE WHEN kind = 'table' THEN array_to_string(cells, ' | ') ELSE text END, chr(10) ORDER BY page, line),
                          '([A-Za-zÆØÅæøå])-\n([a-zæøå])', '\1\2', 'g'), chr(10), ' ') AS text FROM cut GROUP BY doc, block, piece),
steps AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY block) - 1 AS n, CASE WHEN block = piece THEN 2 ELSE 1 END AS gap FROM joined),
placed AS (SELECT *, CAST(sum(length(text) + gap) OVER (PARTITION BY doc ORDER BY piece) - length(text) - 2 AS BIGINT) AS start FROM steps)
"""
QUERIES = {
    "page_lines": (
        page_lines,
        f"WITH {_LINES} SELECT doc, page, line, sha256(text) AS text, half, bold, kind, number, CAST(len(cells) AS INTEGER) AS cells FROM kinds",
    ),
    "heading_kinds": (heading_kinds, f"WITH {_LINES}, {_LEVELS} SELECT doc, half, CAST(depth AS INTEGER) AS depth, level FROM levels"),
    "structure_blocks": (
        structure_blocks,
        rf"""WITH {_LINES}, {_LEVELS}, {_BLOCKS}
             SELECT doc, n AS block, kind, CASE WHEN kind = 'heading' THEN level END AS level,
                    CASE WHEN kind = 'heading' AND (regexp_matches(text, '{NUMBERED}') OR regexp_matches(text, '^§\s*\d')) THEN regexp_extract(text, '{LEADING_NUMBER}', 1) END AS section_number,
                    sha256(text) AS text, start, start + length(text) AS "end", max(start + length(text)) OVER (PARTITION BY doc, n) AS block_end
             FROM placed LEFT JOIN levels USING (doc, half, depth)""",
    ),
    "structure_pages": (
        structure_pages,
        rf"""WITH {_LINES}, {_BLOCKS},
             shares AS (SELECT c.doc, c.piece, c.page, p.start, length(p.text) AS n, sum(length(c.text) + 1) AS share
                        FROM cut c JOIN placed p USING (doc, piece) GROUP BY c.doc, c.piece, c.page, p.start, p.text),
             ends AS (SELECT *, CASE WHEN page = max(page) OVER (PARTITION BY doc, piece) THEN start + n END AS last,
                             floor(n * share / sum(share) OVER (PARTITION BY doc, piece) + 0.5) AS part FROM shares),
             spans AS (SELECT doc, page, coalesce(last, least(start + n, start + sum(part) OVER w)) AS stop,
                              least(start + n, start + coalesce(sum(part) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS first
                       FROM ends WINDOW w AS (PARTITION BY doc, piece ORDER BY page)),
             own AS (SELECT b.doc, b.page, min(first) AS first, max(stop) AS stop FROM bare b LEFT JOIN spans USING (doc, page) GROUP BY b.doc, b.page),
             come AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS come FROM own)
             SELECT doc, page, first IS NOT NULL AS has_text, CAST(greatest(coalesce(first, come), come) AS BIGINT) AS start,
                    CAST(greatest(coalesce(stop, come), coalesce(first, come), come) AS BIGINT) AS "end" FROM come""",
    ),
    "heading_tree": (
        heading_tree,
        rf"""WITH RECURSIVE {_LINES}, {_LEVELS}, {_BLOCKS},
             heads AS (SELECT doc, piece, level, text FROM placed JOIN levels USING (doc, half, depth) WHERE kind = 'heading'),
             above AS (SELECT h.doc, h.piece, max(a.piece) AS parent FROM heads h LEFT JOIN heads a ON a.doc = h.doc AND a.piece < h.piece AND a.level < h.level GROUP BY h.doc, h.piece),
             up AS (SELECT doc, piece, piece AS at, 0 AS far FROM heads UNION ALL SELECT u.doc, u.piece, a.parent, far + 1 FROM up u JOIN above a ON a.doc = u.doc AND a.piece = u.at WHERE a.parent IS NOT NULL)
             SELECT u.doc, u.piece[1] AS page, u.piece[2] AS line, CAST(count(*) AS INTEGER) AS depth, sha256(string_agg(h.text, ' > ' ORDER BY far DESC)) AS path
             FROM up u JOIN heads h ON h.doc = u.doc AND h.piece = u.at GROUP BY u.doc, u.piece""",
    ),
    "section_chunk_rows": (section_chunk_rows, None),
    "exact_ranks": (
        exact_ranks,
        """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n
                      FROM events WHERE value IS NOT NULL)
           SELECT event_type, p, n, floor(value * 1e6 + 0.5) / 1e6 AS value
           FROM r, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p) WHERE i = greatest(1, CAST(ceil(p * n - 1e-9) AS BIGINT))""",
    ),
}
