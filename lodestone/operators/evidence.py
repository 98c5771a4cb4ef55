"""From chunks to evidence: the search within the allowed set, merged items, conflicts and signals."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col, holds, six
from lodestone.operators.search import islands, lexical_top_k, ranked, vector_top_k

NO_RANK = 1_000_000


def checked_request(query: str | None, k: int, mode: str) -> None:
    """Raises for a request out of range (FLT-7)."""
    if not 1 <= k <= 200:
        raise ValueError("k must be 1 to 200")
    if query is not None and len(query) > 1000:
        raise ValueError("a query has at most 1000 characters")
    if mode not in ("current", "historical"):
        raise ValueError("mode is current or historical")


def search_chunks(chunks: DataFrame, vectors: DataFrame, allowed: DataFrame, probe: Sequence[float] | None, terms: Sequence[str], k: int = 50) -> DataFrame:
    """Candidates of both retrievers among the chunks of allowed versions, in their final order (RET-2, SRT-3).
    chunks: chunk_id, version, text; vectors: chunk_id, embedding; allowed: version and what else is wanted.

    The access filter comes before either search, so nothing that may not be read takes a rank."""
    checked_request(None, k, "current")
    own = chunks.join(allowed.select("version").distinct(), "version", "left_semi")
    near = vector_top_k(vectors.join(own.select("chunk_id"), "chunk_id", "left_semi"), probe or [], k)
    both = near.join(lexical_top_k(own, terms, k), "chunk_id", "full")
    best = F.least(F.coalesce("vector_rank", F.lit(NO_RANK)), F.coalesce("lexical_rank", F.lit(NO_RANK)))
    placed = ranked(both.withColumn("best", best), 2 * k, [F.col("best"), F.col("chunk_id")], "position").drop("best")
    found = placed.join(own.select("chunk_id", "version"), "chunk_id")
    return found.join(allowed, "version")


def merged_text(parts: Column | str) -> Column:
    """One text of slices (start, stop, text) in order: what overlaps is taken once, gaps of up to two characters
    are line breaks; null where a gap is longer or a slice lies within what is there (STR-18)."""
    none = F.struct(F.lit(None).cast("int").alias("stop"), F.lit("").alias("text"), F.lit(True).alias("good"))

    def add(held: Column, part: Column) -> Column:
        stop, repeated = held["stop"], held["stop"] - part["start"]
        more = (
            F.when(stop.isNull(), part["text"])
            .when(repeated >= 0, F.substring(part["text"], repeated + F.lit(1), F.length(part["text"])))
            .otherwise(F.concat(F.repeat(F.lit("\n"), -repeated), part["text"]))
        )
        good = held["good"] & F.coalesce((repeated <= F.length(part["text"])) & (repeated >= -2), F.lit(True))
        return F.struct(F.greatest(stop, part["stop"]).alias("stop"), F.concat(held["text"], more).alias("text"), good.alias("good"))

    return F.aggregate(col(parts), none, add, lambda x: F.when(x["good"], x["text"]))


def source_label(title: Column | str, version: Column | str, section: Column | str, heading: Column | str, first: Column | str, last: Column | str) -> Column:
    """How a source is named: title, version, section or heading, pages; what is missing is left out (STR-13)."""
    pages = F.when(col(first) == col(last), F.format_string("side %d", col(first))).otherwise(F.format_string("side %d–%d", col(first), col(last)))
    section = F.when(F.coalesce(col(section), F.lit("")) != "", F.concat(F.lit("§"), col(section))).otherwise(F.nullif(col(heading), F.lit("")))
    version = F.when(F.coalesce(col(version), F.lit("")) != "", F.concat(F.lit("version "), col(version)))
    return F.concat_ws(", ", F.nullif(col(title), F.lit("")), version, section, pages)


def evidence_items(chunks: DataFrame) -> DataFrame:
    """One row for each run of neighbouring chunks of a version: best scores, pages, sorted terms, and the merged
    excerpt (RET-5). chunks: version, chunk_index, char_start, char_end, text, page, score, terms."""
    part = F.struct("chunk_index", F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("stop"), "text")
    made = islands(chunks, ["version"], "chunk_index").groupBy("version", "island").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max("score").alias("score"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
    )
    slices = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["text"].alias("text")))
    excerpt = F.coalesce(merged_text(slices), F.col("parts")[0]["text"])
    return made.select("version", F.col("island").alias("chunk_index"), F.size("parts").alias("chunks"), six("score").alias("score"), "page_start", "page_end", "terms", excerpt.alias("excerpt"))


def conflicts_on(chunks: DataFrame, passages: DataFrame, conflicts: DataFrame, versions: DataFrame, readable: DataFrame, day: datetime.date) -> DataFrame:
    """(chunk_id, restricted, conflict, document, counterpart, counterpart_chunk): the other sides of the open conflicts that
    chunks take part in, and one row without ids for all that may not be read (RET-4, JOIN-10). Both sides have to be published
    and hold on the day; chunks that may not be read have no conflicts.

    chunks: version, chunk_id; passages: conflict, side, version, chunk_id (null: the whole version); conflicts: conflict, status;
    versions: version, document, status, valid_from, valid_to; readable: version."""
    valid = versions.filter((F.col("status") == "published") & holds("valid_from", "valid_to", day)).select("version", "document")
    seen = readable.select("version").distinct()
    asked = chunks.select("version", "chunk_id").join(valid, "version", "left_semi").join(seen, "version", "left_semi")
    own = passages.join(conflicts.filter("status = 'open'").select("conflict"), "conflict", "left_semi").select("conflict", "side", "version", F.col("chunk_id").alias("part"))
    exact = asked.join(own.filter("part is not null").withColumnRenamed("part", "chunk_id"), ["version", "chunk_id"])
    whole = asked.join(own.filter("part is null").drop("part"), "version")
    mine = exact.unionByName(whole).select("chunk_id", "conflict", F.col("side").alias("mine")).distinct()
    other = own.join(valid, "version").join(seen.withColumn("seen", F.lit(True)), "version", "left")
    met = mine.join(other.select("conflict", "side", "document", F.col("version").alias("counterpart"), F.col("part").alias("counterpart_chunk"), "seen"), "conflict")
    met = met.filter(F.col("side") != F.col("mine")).drop("side", "mine").distinct()
    names = ["conflict", "document", "counterpart", "counterpart_chunk"]
    shown = met.filter("seen").select("chunk_id", F.lit(False).alias("restricted"), *names)
    none = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in names]
    return shown.unionByName(met.filter("seen is null").select("chunk_id").distinct().select("chunk_id", F.lit(True).alias("restricted"), *none))


def signals(items: DataFrame, *by: str) -> DataFrame:
    """(items, top_score, has_conflicts, has_historical) of a set of evidence, or of each set by some columns; without
    such columns one row, also without items (RET-6)."""
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for c, n in ((F.col("conflicts") > 0, "has_conflicts"), (F.col("temporal_status") == "historical", "has_historical"))]
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.max("score").alias("top_score"), *flags)

