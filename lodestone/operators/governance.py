"""Validity, conflicts, access and trees."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import overlaps
from lodestone.sources.tables import cut


def with_ends(versions: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """versions with valid_to: where the next one of the key begins (WIN-3)."""
    return versions.withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start, tie)))


def gaps(versions: DataFrame, key: str) -> DataFrame:
    """(key, gap_from, gap_to) between versions (valid_from, valid_to), and after the last if it ends (RET-8).
    What any version before covers is no gap."""
    before = Window.partitionBy(key).orderBy("valid_from", "valid_to")
    far = F.coalesce("valid_to", F.lit(datetime.date(9999, 12, 31)))
    reach = F.max(far).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = versions.select(key, "valid_from", reach.alias("reach"), F.lead("valid_from").over(before).alias("next"))
    open_end = F.col("reach") < F.lit(datetime.date(9999, 12, 31))
    return rows.filter(open_end & (F.col("next").isNull() | (F.col("next") > F.col("reach")))).select(key, F.col("reach").alias("gap_from"), F.col("next").alias("gap_to"))


def overlap_pairs(versions: DataFrame, key: str, version: str, days: int = 180) -> DataFrame:
    """(key, fingerprint) of each two versions of a key whose intervals overlap (JOIN-6, RET-7). Versions meet in
    stretches of `days`, a pair in the one where the later of both begins, so versions far apart never meet."""
    since = F.lit(datetime.date(1970, 1, 1))

    def stretch(day: Column) -> Column:
        return F.floor(F.datediff(day, since) / days).cast("long")

    most = F.broadcast(versions.agg(F.max("valid_from").alias("most")))  # one row
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("most")), F.col("most"))
    rows = versions.crossJoin(most).filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    rows = rows.select(key, version, "valid_from", "valid_to", F.explode(F.sequence(stretch(F.col("valid_from")), stretch(F.greatest("valid_from", end)))).alias("stretch"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.col(f"a.{version}") < F.col(f"b.{version}")))
    first = F.col("a.stretch") == stretch(F.greatest("a.valid_from", "b.valid_from"))
    both = both.filter(first & overlaps(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to")))
    return both.select(F.col(f"a.{key}").alias(key), F.concat_ws(":", F.lit("overlapping_scope"), f"a.{version}", f"b.{version}").alias("fingerprint"))


def closure(edges: DataFrame, most: int = 32) -> DataFrame:
    """(ancestor, node, depth): every node under each ancestor of (parent, child) edges, itself at depth 0; a
    cycle ends where it closes (REC-1). Raises if paths are longer than `most`."""
    nodes = edges.select(F.col("parent").alias("n")).union(edges.select("child")).distinct()
    seen = nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(edges, frontier.node == edges.parent).select("ancestor", F.col("child").alias("node")).distinct()
        frontier = step.join(seen, ["ancestor", "node"], "left_anti")
        frontier = cut(frontier.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"paths of over {most} edges")


def readable(documents: DataFrame, grants: DataFrame, members: DataFrame, teams: DataFrame, user: str) -> DataFrame:
    """Ids of the documents that a user may read: granted to all, to them, to a team of theirs, or to a team
    above one with its descendants (FLT-3). teams: closure(); grants: document, kind, grantee, descendants."""
    mine = members.filter(F.col("user") == user).select("team")
    above = teams.join(mine, teams.node == mine.team, "left_semi").select(F.col("ancestor").alias("grantee")).distinct()
    ids = [
        grants.filter("kind = 'all_users'").select("document"),
        grants.filter((F.col("kind") == "user") & (F.col("grantee") == user)).select("document"),
        grants.filter("kind = 'team'").join(mine.withColumnRenamed("team", "grantee"), "grantee", "left_semi").select("document"),
        grants.filter("kind = 'team' and descendants").join(above, "grantee", "left_semi").select("document"),
    ]
    found = ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct()
    return documents.join(found, "document", "left_semi")


def conflict_closure(passages: DataFrame, start: DataFrame, rounds: int = 10) -> DataFrame:
    """(chunk): everything reached from start over conflicts, by going to the other side again and again
    (JOIN-5, REC-2). passages: conflict, side, chunk. Raises after `rounds`."""
    seen = start.select("chunk").distinct()
    frontier = seen
    for _ in range(rounds):
        mine = frontier.join(passages, "chunk").select("conflict", F.col("side").alias("mine"))
        other = passages.join(mine, "conflict").filter(F.col("side") != F.col("mine")).select("chunk").distinct()
        frontier = cut(other.join(seen, "chunk", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"not closed after {rounds} rounds")


def transitions_not_allowed(events: DataFrame, allowed: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Status changes that are not among the allowed pairs (old, new) (FLT-19)."""
    old = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    changes = events.withColumn("old", old).withColumn("new", F.col(status)).filter("old is not null and old <> new")
    return changes.join(allowed, ["old", "new"], "left_anti")
