"""Who may read what: the access filter of every read, ordered decisions on files, answers and sessions.

Decisions are column expressions over the names given in their docstrings, so that they fit any table; null
counts as not given, and never as allowed.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col, holds, temporal_status


def first_of(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The code of the first rule that holds; a rule that is null does not."""
    return F.coalesce(*[F.when(rule, F.lit(code)) for rule, code in rules], F.lit(otherwise).cast("string"))


def readable_versions(versions: DataFrame, readable: DataFrame, historical: DataFrame, today: datetime.date) -> DataFrame:
    """The published versions that a user may read, with temporal_status (SRC-1, FLT-2): past ones by the grant of
    history, all others by that of reading. versions: document, status, valid_from, valid_to; grants: document."""
    published = versions.filter("status = 'published'").withColumn("temporal_status", temporal_status("valid_from", "valid_to", today))
    past = F.col("temporal_status") == "historical"
    now = published.filter(~past).join(readable.select("document").distinct(), "document", "left_semi")
    return now.unionByName(published.filter(past).join(historical.select("document").distinct(), "document", "left_semi"))


def allowed_versions(
    versions: DataFrame,
    readable: DataFrame,
    historical: DataFrame,
    today: datetime.date,
    day: datetime.date,
    language: str,
    products: Sequence | None = None,
    documents: Sequence | None = None,
    types: Sequence | None = None,
) -> DataFrame:
    """Of the readable versions those in a language that are valid on a day, of the products, documents and types
    asked for; None asks for all (FLT-1)."""
    made = readable_versions(versions, readable, historical, today).filter((F.col("language") == language) & holds("valid_from", "valid_to", day))
    for name, wanted in (("product", products), ("document", documents), ("type", types)):
        if wanted is not None:
            made = made.filter(F.col(name).isin(list(wanted)))
    return made


def subject_access(scopes: Column | str, me: Column | str, subject: Column | str, led: Column | str) -> Column:
    """Whether `me` may see data of `subject`: by the scope all, own, or team for those that `me` leads (FLT-5)."""
    scopes, me, subject = col(scopes), col(me), col(subject)
    has = [F.array_contains(scopes, s) for s in ("all", "own", "team")]
    allowed = has[0] | (has[1] & (me == subject)) | (has[2] & col(led))
    return F.coalesce(me.isNotNull() & subject.isNotNull() & allowed, F.lit(False))


def subjects(people: DataFrame, others: DataFrame, me: str, subject: str, team: str) -> DataFrame:
    """(me, subjects): how many of the others of its team each of the people may see, as subject_access tells of each pair; all of them
    are led. They are counted by team, and looked up by themselves, so that people and others don't meet as pairs. people:
    me, team, scopes; others: subject, team."""
    sizes = others.groupBy(team).agg(F.count(subject).alias("_all"))
    own = others.groupBy(F.col(subject).alias(me), team).agg(F.count("*").alias("_own"))
    scopes = F.col("scopes")
    whole = F.coalesce(F.array_contains(scopes, "all") | F.array_contains(scopes, "team"), F.lit(False))
    seen = F.when(F.col(me).isNull(), None).when(whole, F.col("_all")).when(F.array_contains(scopes, "own"), F.col("_own"))
    made = people.join(sizes, team, "left").join(own, [me, team], "left")
    return made.select(me, F.coalesce(seen, F.lit(0)).alias("subjects"))


def participants(people: DataFrame, case: str, role: str, name: str, order: Sequence[str]) -> DataFrame:
    """(case, participants): names of each case's people, by the order of their roles, then by name (FLT-6)."""
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col(role))
    place = F.when(place == 0, len(order) + 1).otherwise(place)
    made = people.groupBy(case).agg(F.array_sort(F.collect_set(F.struct(place.alias("place"), F.col(name).alias("name")))).alias("p"))
    return made.select(case, F.col("p.name").alias("participants"))


def gating(assessment: Column | str, roleplay: Column | str, turn: Column | str, session: Column | str) -> Column:
    """struct<allowed, reason> of an action while an assessment or a roleplay is active. turn: whether the action
    is a roleplay turn, session: the one it names, roleplay: the active one (FLT-14)."""
    turn, active = col(turn), col(roleplay)
    reason = first_of(
        (col(assessment), "assessment_active"),
        (active.isNotNull() & ~(turn & active.eqNullSafe(col(session))), "roleplay_active"),
        (active.isNull() & turn, "no_active_roleplay"),
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def release_block(policy: Column | str) -> Column:
    """The first of eleven rules that keeps a version from release, or null (FLT-9). Columns: version, state,
    verdict, verdict_version, final, superseded_at, released_at, verdict_policy, malware, structural, pdf, active,
    verdict_sha, sha, bytes_sha, verdict_path, path, bucket; policy: the active one's version."""
    c = F.col
    passed = (c("malware") == "clean") & (c("structural") == "pass") & (c("pdf") == "pass") & (c("active") == "pass")
    return first_of(
        (c("version").isNull(), "version_unknown"),
        (~c("state").eqNullSafe(F.lit("released")), "not_released"),
        (c("verdict").isNull() | (c("verdict_version") != c("version")), "no_verdict"),
        (c("final") != "safe", "verdict_not_safe"),
        (c("superseded_at").isNotNull(), "verdict_superseded"),
        (c("released_at").isNull(), "verdict_not_released"),
        (col(policy).isNull() | (c("verdict_policy") != col(policy)), "policy_outdated"),
        (~F.coalesce(passed, F.lit(False)), "verdict_incomplete"),
        (c("verdict_sha") != c("sha"), "checksum_mismatch"),
        (c("bytes_sha") != c("verdict_sha"), "bytes_changed"),
        ((c("verdict_path") != c("path")) | (c("bucket") != "knowledge-originals"), "object_mismatch"),
    )


def final_verdict(now: Column | str, policy: Column | str, age: str, engines: Sequence[str] = ("ClamAV",)) -> Column:
    """struct<verdict, code> of a scanned file by nine ordered branches, safe only if all is passed (FLT-10, DAT-9,
    SET-4). Columns: malware, malware_code, structural, structural_code, checksum, expected_checksum, size,
    expected_size, engine, signed_at, policy_version, pdf, pdf_code, active, findings; age: the longest age of
    signatures, as an interval."""
    c, now = F.col, col(now)
    soft = F.array(F.lit("embedded_file"), F.lit("file_attachment"))
    embedded = F.size(F.array_except("findings", soft)) == 0
    other = (c("checksum") != c("expected_checksum")) | (c("expected_size").isNotNull() & (c("size") != c("expected_size")))
    stale = c("signed_at").isNull() | (c("signed_at") > now + F.expr("interval 5 minutes")) | (now - F.expr(f"interval {age}") > c("signed_at"))

    def made(verdict: str, code: Column | str | None) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), (code if isinstance(code, Column) else F.lit(code)).cast("string").alias("code"))

    unfinished = ~F.coalesce((c("pdf") == "pass") & (c("active") == "pass") & (c("malware") == "clean"), F.lit(False))
    return (
        F.when(c("malware") == "infected", made("rejected", "malware_detected"))
        .when(c("structural") == "fail", made("rejected", c("structural_code")))
        .when(other, made("rejected", "checksum_mismatch"))
        .when(c("malware").isin("error", "not_scanned"), made("scan_failed", F.coalesce("malware_code", F.lit("scanner_error"))))
        .when(c("engine").isNull() | ~c("engine").isin(list(engines)), made("scan_failed", "scanner_not_allowed"))
        .when(stale, made("scan_failed", "stale_signatures"))
        .when(c("policy_version") != col(policy), made("scan_failed", "policy_outdated"))
        .when(c("pdf").isin("fail", "error"), made("rejected", c("pdf_code")))
        .when(c("active") == "fail", made("rejected", F.when(embedded, "embedded_file").otherwise("active_content")))
        .when(unfinished, made("scan_failed", "inspection_incomplete"))
        .otherwise(made("safe", None))
    )


def production_grade(conditions: Sequence[tuple[str, Column]]) -> Column:
    """struct<grade, unmet> of named conditions (P1 to P9); one that is null is not met (FLT-16)."""
    unmet = F.filter(F.array(*[F.when(F.coalesce(met, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, met in conditions]), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(unmet) == 0, "production").otherwise("development").alias("grade"), unmet.alias("unmet"))


def minimised(context: Column | str, allowed: Sequence[str]) -> Column:
    """struct<kept, removed> of a map: the entries with allowed keys, and how many others there were (FLT-18)."""
    context = F.coalesce(col(context), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(context, lambda k, _: k.isin(list(allowed)))
    return F.struct(kept.alias("kept"), (F.size(context) - F.size(kept)).alias("removed"))


#: What an alarm's details may hold.
DETAIL_KEY = "^[a-z][a-z0-9_]{0,40}$"
DETAIL_TOKEN = "^[A-Za-z0-9_.:/@+,-]{0,200}$"
MOST_DETAILS = 20


def sanitised(details: Column | str) -> Column:
    """struct<kept, dropped> of a map of strings: up to 20 short tokens under plain keys, and how many entries
    went; numbers come as their text (FLT-20)."""
    entries = F.coalesce(F.map_entries(col(details)), F.array().cast("array<struct<key:string,value:string>>"))
    good = F.filter(entries, lambda e: F.coalesce(e["key"].rlike(DETAIL_KEY) & e["value"].rlike(DETAIL_TOKEN), F.lit(False)))
    kept = F.slice(good, 1, MOST_DETAILS)
    return F.struct(F.map_from_entries(kept).alias("kept"), (F.size(entries) - F.size(kept)).alias("dropped"))
