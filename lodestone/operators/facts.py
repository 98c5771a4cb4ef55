"""Quality facts of versions, the plan of a publication, and the state of a review (AGG-23, RET-11).

Overlaps and gaps follow from counts of the starts and ends of published versions up to a day: as many hold that day as
have begun and not ended. So versions meet no others, but their own first and last day, and a document may have any number of them.

versions: version, document, language, status (under_review, published, discarded and others), label, title, document_type, product,
valid_from, valid_to (null: open), superseded, checksum. An interval is half open; where it has no start, or ends before it
begins, it overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import carried
from lodestone.operators.review import named_findings
from lodestone.sources.tables import cut

GROUP = ["document", "language"]


def _day(x: str | Column) -> Column:
    return F.unix_date(x)


def _days(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """For each day that is asked for (document, language, at) or on which a published version begins or ends: begun_before and
    ended_before that day, begun and ended with it, last_end before it, last (to have begun, with that day) and next, the first day after
    it on which one begins. One row a day, however many versions meet there."""
    some = versions.filter((F.col("status") == "published") & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))))
    end = F.coalesce(_day("valid_to"), F.lit(1 << 30)).alias("until")
    own = F.struct(_day("valid_from").alias("since"), "version", end, F.coalesce("superseded", F.lit(False)).alias("superseded"))
    starts = some.groupBy(*GROUP, _day("valid_from").alias("at")).agg(F.count("*").alias("b"), F.max(own).alias("own"))
    ends = some.filter("valid_to is not null").groupBy(*GROUP, _day("valid_to").alias("at")).agg(F.count("*").alias("e"))
    every = starts.unionByName(ends, True).unionByName(asked.distinct(), True).groupBy(*GROUP, "at")
    every = every.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.max("own").alias("own"))
    every = every.withColumn("start", F.when(F.col("b") > 0, F.col("at"))).withColumn("end", F.when(F.col("e") > 0, F.col("at")))
    run = carried(every, GROUP, ["at"], sums=["b", "e"], maxima=["end"], last=["own"])
    run = carried(run.withColumn("back", -F.col("at")), GROUP, ["back"], last=["start"])
    return run.select(
        *GROUP, "at", F.col("before_b").alias("begun_before"), F.col("before_e").alias("ended_before"), (F.col("before_b") + F.col("b")).alias("begun"), (F.col("before_e") + F.col("e")).alias("ended"),
        F.col("top_end").alias("last_end"), F.coalesce("own", "prev_own").alias("last"), F.col("prev_start").alias("next"),
    )


def quality_facts(versions: DataFrame, grants: DataFrame) -> DataFrame:
    """(version, missing, duplicates, overlaps, gap_before, gap_after, no_grants, ok, predecessor, plan_gap): facts of all versions, and for
    those that are not published the plan of their publication. grants: document. Of several published versions that
    hold on a day the one that began last is the predecessor."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    missing = named_findings(("version_label", F.col("label").isNull()), ("valid_from", F.col("valid_from").isNull()), ("title", blank), ("language", F.col("language").isNull()))
    dated = F.col("valid_from").isNotNull()
    v = versions.select(
        "version", *GROUP, "status", "checksum", missing.alias("missing"), _day("valid_from").alias("since"), _day("valid_to").alias("until"),
        F.when(dated, _day("valid_from")).otherwise(-(1 << 29)).alias("first"), F.when(dated & F.col("valid_to").isNotNull(), _day("valid_to")).otherwise(1 << 29).alias("past"),
    )
    days = cut(_days(versions, v.select(*GROUP, F.explode(F.array("first", "past")).alias("at"))))
    granted = grants.select("document").distinct().withColumn("granted", F.lit(True))
    # A version meets its two days only; what else is known of its document comes with them. Days are as many as versions where no two
    # share one, and much smaller in files than in memory, so they are not broadcast.
    begins = days.join(granted, "document", "left").select(*[F.col(g).alias(f"_{g}") for g in GROUP], F.col("at").alias("first"), "granted", F.struct("begun_before", "ended_before", "ended", "last_end", "last").alias("from"))
    ceases = days.select(*[F.col(g).alias(f"_{g}") for g in GROUP], F.col("at").alias("past"), F.struct("begun_before", "begun", "ended", "next").alias("to"))
    for at, found in (("first", begins), ("past", ceases)):
        same = v[at] == found[at]
        for g in GROUP:
            same = same & v[g].eqNullSafe(found[f"_{g}"])
        v = v.join(found.hint("merge"), same, "left").drop(*[f"_{g}" for g in GROUP], at)
    alike = versions.filter("status <> 'discarded' and checksum is not null").groupBy("checksum").agg(F.count("*").alias("same"))
    v = v.join(alike, "checksum", "left")
    dated, since, until = F.col("since").isNotNull(), F.col("since"), F.col("until")
    public, real = F.col("status") == "published", F.col("until").isNull() | (F.col("since") < F.col("until"))
    overlaps = F.when(dated & real, F.col("to.begun_before") - F.col("from.ended") - F.when(public, 1).otherwise(0))
    held_before, held_after = F.col("from.begun_before") > F.col("from.ended_before"), F.col("to.begun") > F.col("to.ended")
    p = F.when(~public & (F.col("from.last.until") > since), F.col("from.last"))
    v = v.withColumns({"overlaps": F.coalesce(overlaps, F.lit(0).cast("long")), "p": p})
    others = F.col("overlaps") - F.when(F.col("p").isNotNull() & real, 1).otherwise(0)
    ok = dated & ~F.coalesce((F.col("p.since") >= since) | F.col("p.superseded"), F.lit(False)) & (others <= 0)
    cut_short = F.coalesce(ok, F.lit(False)) & F.col("p").isNotNull() & until.isNotNull() & (F.col("p.until") > until)
    return v.select(
        "version", "missing", F.greatest(F.coalesce("same", F.lit(0)) - F.when(F.col("status") != "discarded", 1).otherwise(0), F.lit(0)).alias("duplicates"), "overlaps",
        F.when(dated & ~held_before, F.date_from_unix_date("from.last_end")).alias("gap_before"), F.when(dated & until.isNotNull() & ~held_after, F.date_from_unix_date("to.next")).alias("gap_after"),
        F.col("granted").isNull().alias("no_grants"), F.when(~public, ok).alias("ok"), F.when(~public & ok, F.col("p.version")).alias("predecessor"), F.coalesce(~public & cut_short, F.lit(False)).alias("plan_gap"),
    )


def review_states(versions: DataFrame, facts: DataFrame, pages: DataFrame, reports: DataFrame, vectors: DataFrame) -> DataFrame:
    """(version, blockers, warnings): what keeps each version from being approved, and what to look at, in order (RET-11).

    pages: version, has_text; reports: version, finished_at, all_read, recognized, without_heading, uncertain_tables, encoding_warnings (the
    last one counts); vectors: version, chunks, embedded (by the active model)."""
    last = reports.groupBy("version").agg(F.max_by(F.struct("all_read", "recognized", "without_heading", "uncertain_tables", "encoding_warnings"), F.col("finished_at")).alias("r"))
    read = pages.groupBy("version").agg(F.count("*").alias("pages"), F.count_if(~F.coalesce("has_text", F.lit(False))).alias("unread"))
    v = versions.join(facts.drop("missing"), "version").join(last, "version", "left").join(read, "version", "left").join(vectors, "version", "left")
    fields = F.col("label").isNull() | F.col("valid_from").isNull() | (F.coalesce(F.trim("title"), F.lit("")) == "") | F.col("document_type").isNull() | F.col("product").isNull() | F.col("language").isNull()
    blockers = named_findings(
        ("not_under_review", ~F.col("status").eqNullSafe(F.lit("under_review"))),
        ("metadata_missing", fields),
        ("pages_unread", F.coalesce(F.col("unread") > 0, F.lit(True)) | ~F.coalesce("r.all_read", F.lit(False))),
        ("embeddings_missing", ~F.coalesce((F.col("chunks") > 0) & (F.col("embedded") >= F.col("chunks")), F.lit(False))),
        ("validity_conflict", F.col("valid_from").isNotNull() & ~F.coalesce("ok", F.lit(False))),
    )
    warnings = named_findings(
        ("no_grants", F.col("no_grants")),
        ("duplicate", F.col("duplicates") > 0),
        ("predecessor_superseded", F.col("predecessor").isNotNull()),
        ("validity_gap", F.col("plan_gap") | F.col("gap_before").isNotNull()),
        ("structure_not_recognized", ~F.coalesce("r.recognized", F.lit(True))),
        ("chunks_without_heading", F.col("r.without_heading") > 0),
        ("uncertain_tables", F.col("r.uncertain_tables") > 0),
        ("encoding", F.col("r.encoding_warnings") > 0),
    )
    return v.select("version", blockers.alias("blockers"), warnings.alias("warnings"))
