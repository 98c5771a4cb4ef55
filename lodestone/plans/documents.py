"""Queries on document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.columns import initials, safe_name, token_estimate, tokens
from lodestone.functions.python import canonical_json, hash_embedding, redacted, sentences
from lodestone.operators.documents import chunks, repeated_lines
from lodestone.sources.tables import table


def token_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(tokens("text")).cast("bigint").alias("tokens"), F.size(F.array_distinct(tokens("text"))).cast("bigint").alias("distinct_tokens"), token_estimate("text").alias("estimate"))


def header_footer(spark, sf):
    """Lines at the top or bottom of half of a source's documents and more (AGG-21)."""
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    return repeated_lines(d, "source", "doc_id", edge=2)


def page_headers(spark, sf):
    """Lines at the top or bottom of half of a host's pages and more (AGG-21); a page's tags end its lines."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id", F.regexp_replace("html", ">", ">\n").alias("text"))
    return repeated_lines(p, "host", "page_id", edge=2)


def repeated_line_counts(spark, sf):
    """Masked lines found in three or more documents (STR-2, AGG-21)."""
    from lodestone.functions.columns import line_key

    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", line_key("raw").alias("line"))
    made = lines.filter("line <> ''").distinct().groupBy("line").agg(F.count("*").alias("documents"))
    return made.filter("documents >= 3").select(F.sha2("line", 256).alias("line_hash"), "documents")


def redact_emails(spark, sf):
    pattern = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    d = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("emails"), F.sha2(F.regexp_replace("text", pattern, "[EMAIL]"), 256).alias("text_hash"))
    return d.filter("emails > 0")


def redact_all(spark, sf):
    """AGG-31."""
    d = table(spark, sf, "documents").select("doc_id", redacted("text").alias("r"))
    return d.select("doc_id", F.explode("r.counts").alias("kind", "n"))


def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(sentences("text")).cast("bigint").alias("sentences"))


def chunk_documents(spark, sf):
    return chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", "char_start", "char_end", "overlap_chars", "content_hash")


def hash_embed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hash_embedding("text", 256).alias("embedding"))


def canonical_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.sha2(canonical_json("props"), 256).alias("checksum")).agg(F.count("*").alias("n"))


def name_forms(spark, sf):
    """Initials, file names and format checks of names (STR-14, STR-15, STR-16, STR-17)."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", initials(F.regexp_replace("c_name", "#", " ")).alias("initials"), safe_name("c_name").alias("file_name"), F.col("c_name").rlike("^Customer#[0-9]+$").alias("well_formed"))


QUERIES = {
    "token_stats": (
        token_stats,
        r"""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS estimate
            FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}§]+') AS t FROM documents)""",
    ),
    "repeated_line_counts": (
        repeated_line_counts,
        r"""SELECT sha256(line) AS line_hash, count(*) AS documents FROM (
              SELECT DISTINCT doc_id, regexp_replace(lower(trim(raw)), '[0-9]+', '#', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents))
            WHERE line <> '' GROUP BY line HAVING count(*) >= 3""",
    ),
    "header_footer": (
        header_footer,
        r"""WITH p AS (SELECT source AS source, doc_id, list_filter(list_transform(string_split(text, chr(10)),
                        lambda y: trim(regexp_replace(y, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda y: y <> '') AS lines FROM documents),
                 f AS (SELECT source, doc_id, CASE WHEN len(lines) <= 4 THEN lines ELSE list_concat(lines[1:2], lines[-2:]) END AS edge FROM p WHERE len(lines) > 0),
                 k AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(y), '[0-9]+', '#', 'g') AS line FROM (SELECT source, doc_id, unnest(edge) AS y FROM f)),
                 n AS (SELECT source, count(DISTINCT doc_id) AS n FROM f GROUP BY source)
            SELECT source, line, count(*) AS pages FROM k JOIN n USING (source) GROUP BY source, line, n HAVING count(*) >= greatest(3, ceil(n / 2))""",
    ),
    "page_headers": (
        page_headers,
        r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id, list_filter(list_transform(string_split(replace(html, '>', '>' || chr(10)), chr(10)),
                        lambda y: trim(regexp_replace(y, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda y: y <> '') AS lines FROM pages),
                 f AS (SELECT host, page_id, CASE WHEN len(lines) <= 4 THEN lines ELSE list_concat(lines[1:2], lines[-2:]) END AS edge FROM p WHERE len(lines) > 0),
                 k AS (SELECT DISTINCT host, page_id, regexp_replace(lower(y), '[0-9]+', '#', 'g') AS line FROM (SELECT host, page_id, unnest(edge) AS y FROM f)),
                 n AS (SELECT host, count(DISTINCT page_id) AS n FROM f GROUP BY host)
            SELECT host, line, count(*) AS pages FROM k JOIN n USING (host) GROUP BY host, line, n HAVING count(*) >= greatest(3, ceil(n / 2))""",
    ),
    "redact_emails": (
        redact_emails,
        r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS emails,
                   sha256(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g')) AS text_hash
            FROM documents WHERE regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')""",
    ),
    "redact_all": (redact_all, None),
    "sentence_split": (sentence_split, None),
    "chunk_documents": (chunk_documents, None),
    "hash_embed": (hash_embed, None),
    "canonical_props": (canonical_props, None),
    "name_forms": (
        name_forms,
        """SELECT c_custkey, upper(array_to_string(list_transform(string_split(trim(replace(c_name, '#', ' ')), ' ')[1:2], lambda p: p[1]), '')) AS initials,
                  replace(c_name, '#', '_') AS file_name, regexp_matches(c_name, '^Customer#[0-9]+$') AS well_formed FROM customer""",
    ),
}
