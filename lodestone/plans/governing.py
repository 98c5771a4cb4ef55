"""Queries of validity, conflicts, access and coverage. Orders stand for versions of a customer's document."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import holds, temporal_status
from lodestone.operators import governance as g
from lodestone.sources.tables import table

DAY, TODAY = datetime.date(1998, 1, 1), datetime.date(1999, 6, 1)


def _versions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), F.to_date("o_orderdate").alias("valid_from"), F.col("o_orderstatus").alias("status"))


def _sixty(spark, sf) -> DataFrame:
    return _versions(spark, sf).withColumn("valid_to", F.date_add("valid_from", 60))


def valid_as_of(spark, sf):
    made = g.with_ends(_versions(spark, sf), "document", "valid_from", "version").filter(holds("valid_from", "valid_to", DAY))
    return made.select("document", "version", "valid_from", "valid_to", temporal_status("valid_from", "valid_to", TODAY).alias("temporal_status"))


def validity_gaps(spark, sf):
    return g.gaps(_sixty(spark, sf), "document")


def gaps_after_withdrawal(spark, sf):
    """Gaps that come up if all versions of status P are withdrawn (RET-9, SET-3)."""
    versions = _sixty(spark, sf)
    return g.gaps(versions.filter("status <> 'P'"), "document").exceptAll(g.gaps(versions, "document"))


def overlap_conflicts(spark, sf):
    return g.overlap_pairs(_sixty(spark, sf), "document", "version")


def publication_plan(spark, sf):
    """Each version's predecessor, and whether publishing it cuts that short or leaves a gap (RET-10)."""
    w = Window.partitionBy("document").orderBy("valid_from", "version")
    made = _sixty(spark, sf).withColumns({"predecessor": F.lag("version").over(w), "ends": F.lag("valid_to").over(w)})
    step = F.when(F.col("predecessor").isNull(), "first").when(F.col("ends") > F.col("valid_from"), "truncates").when(F.col("ends") == F.col("valid_from"), "follows").otherwise("gap_before")
    return made.select("document", "version", "predecessor", step.alias("step"), F.when(step == "truncates", F.datediff("ends", "valid_from")).alias("days_cut"))


def duplicate_content(spark, sf):
    """JOIN-8, MTH-6."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    made = d.groupBy("content_hash").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id"))
    return made.filter("documents > 1")


def _tree(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    root = r.select(F.lit("world").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"))
    return root.union(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))


def team_closure(spark, sf):
    """SET-2."""
    return g.closure(_tree(spark, sf))


def readable_customers(spark, sf):
    """Customers that a member of nation 3's team may read, by grants to all, teams and descendants (FLT-3, JOIN-3)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("document"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    region = F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string"))
    kind = F.when(F.col("segment") == "BUILDING", "team").when(F.col("segment") == "MACHINERY", "team").when(F.col("c_nationkey") == 7, "all_users").otherwise("user")
    grantee = F.when(F.col("segment") == "BUILDING", nation).when(F.col("segment") == "MACHINERY", region).otherwise(F.concat(F.lit("u"), (F.col("document") % 40).cast("string")))
    grants = c.select("document", kind.alias("kind"), grantee.alias("grantee"), (F.col("segment") == "MACHINERY").alias("descendants"))
    members = spark.createDataFrame([("u3", "n3"), ("u4", "n4")], "user string, team string")
    return g.readable(c.select("document", "segment"), grants, members, g.closure(_tree(spark, sf)), "u3")


def scope_gaps(spark, sf):
    """JOIN-4."""
    p = table(spark, sf, "part")
    return p.select("p_brand", "p_type").distinct().join(p.filter("p_size > 48").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "left_anti")


def coverage_matrix(spark, sf):
    """AGG-5."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    segments = c.select("c_mktsegment").distinct()
    made = c.groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct("c_custkey").alias("documents"))
    every = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name").crossJoin(F.broadcast(segments))  # of the fixed lists of nations and segments
    return every.join(made, ["c_nationkey", "c_mktsegment"], "left").select("n_name", "c_mktsegment", F.coalesce("documents", F.lit(0)).alias("documents"))


def status_transitions(spark, sf):
    events = table(spark, sf, "events")
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("click", "error"), ("error", "view")], "old string, new string")
    return g.transitions_not_allowed(events, allowed, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "old", "new")


def policy_strictest(spark, sf):
    """The stricter of a matrix and a profile for each event; a missing row denies (FLT-12)."""
    matrix = spark.createDataFrame([("view", 0), ("click", 0), ("purchase", 1)], "event_type string, strictness int")
    profile = F.when(F.col("value") > 100, 2).otherwise(0)
    made = table(spark, sf, "events").join(matrix, "event_type", "left").withColumn("level", F.greatest(F.coalesce("strictness", F.lit(2)), profile))
    name = F.element_at(F.array(F.lit("allow"), F.lit("redact"), F.lit("deny")), F.col("level") + 1)
    return made.groupBy("event_type", name.alias("decision")).agg(F.count("*").alias("n"))


def changed_fields(spark, sf):
    """Which fields of a customer's orders differ from the order before (WIN-9, JSN-7)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    fields = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    made = table(spark, sf, "orders").withColumn("_first", F.lag("o_orderkey").over(w).isNull())
    differs = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields]
    return made.withColumn("changed", F.concat_ws(",", *differs)).filter("not _first").select("o_orderkey", "changed")


_SIXTY = "s AS (SELECT o_custkey AS document, o_orderkey AS version, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 60 AS valid_to, o_orderstatus AS status FROM orders)"
_GAPS = """SELECT document, reach AS gap_from, nxt AS gap_to FROM (
  SELECT document, max(valid_to) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach, lead(valid_from) OVER w AS nxt
  FROM {} WINDOW w AS (PARTITION BY document ORDER BY valid_from, valid_to)) WHERE nxt IS NULL OR nxt > reach"""
_TREE = "e AS (SELECT 'world' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation), n AS (SELECT parent AS x FROM e UNION SELECT child FROM e), c AS (SELECT x AS ancestor, x AS node, 0 AS depth FROM n UNION SELECT c.ancestor, e.child, c.depth + 1 FROM c JOIN e ON c.node = e.parent)"
QUERIES = {
    "valid_as_of": (
        valid_as_of,
        """SELECT document, version, valid_from, valid_to,
                  CASE WHEN valid_from > DATE '1999-06-01' THEN 'future' WHEN valid_to <= DATE '1999-06-01' THEN 'historical' ELSE 'current' END AS temporal_status
           FROM (SELECT o_custkey AS document, o_orderkey AS version, CAST(o_orderdate AS DATE) AS valid_from,
                        lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS valid_to FROM orders)
           WHERE valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR DATE '1998-01-01' < valid_to)""",
    ),
    "validity_gaps": (validity_gaps, f"WITH {_SIXTY} {_GAPS.format('s')}"),
    "gaps_after_withdrawal": (
        gaps_after_withdrawal,
        f"WITH {_SIXTY}, t AS (SELECT * FROM s WHERE status <> 'P') ({_GAPS.format('t')}) EXCEPT ALL ({_GAPS.format('s')})",
    ),
    "overlap_conflicts": (
        overlap_conflicts,
        f"""WITH {_SIXTY} SELECT a.document, 'overlapping_scope:' || a.version || ':' || b.version AS fingerprint FROM s a
            JOIN s b ON a.document = b.document AND a.version < b.version AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to""",
    ),
    "publication_plan": (
        publication_plan,
        f"""WITH {_SIXTY}, p AS (SELECT *, lag(version) OVER w AS predecessor, lag(valid_to) OVER w AS ends FROM s WINDOW w AS (PARTITION BY document ORDER BY valid_from, version))
            SELECT document, version, predecessor,
                   CASE WHEN predecessor IS NULL THEN 'first' WHEN ends > valid_from THEN 'truncates' WHEN ends = valid_from THEN 'follows' ELSE 'gap_before' END AS step,
                   CAST(CASE WHEN ends > valid_from THEN ends - valid_from END AS INTEGER) AS days_cut FROM p""",
    ),
    "duplicate_content": (
        duplicate_content,
        "SELECT sha256(text) AS content_hash, count(*) AS documents, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "team_closure": (team_closure, f"WITH RECURSIVE {_TREE} SELECT * FROM c"),
    "readable_customers": (
        readable_customers,
        """SELECT c_custkey AS document, c_mktsegment AS segment FROM customer
           WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey = 3
                      WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey % 5 = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)
                      WHEN c_nationkey = 7 THEN true ELSE c_custkey % 40 = 3 END""",
    ),
    "scope_gaps": (scope_gaps, "SELECT DISTINCT p_brand, p_type FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size > 48)"),
    "coverage_matrix": (
        coverage_matrix,
        """SELECT n_name, s.c_mktsegment, count(DISTINCT c_custkey) AS documents FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
           LEFT JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY n_name, n_nationkey, s.c_mktsegment""",
    ),
    "status_transitions": (
        status_transitions,
        """SELECT user_id, event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
           WHERE old <> event_type AND (old, event_type) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'error'), ('click', 'error'), ('error', 'view'))""",
    ),
    "policy_strictest": (
        policy_strictest,
        """SELECT event_type, CASE greatest(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, CASE WHEN value > 100 THEN 2 ELSE 0 END)
                  WHEN 0 THEN 'allow' WHEN 1 THEN 'redact' ELSE 'deny' END AS decision, count(*) AS n FROM events GROUP BY 1, 2""",
    ),
    "changed_fields": (
        changed_fields,
        """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 'o_orderstatus' END,
                  CASE WHEN o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w THEN 'o_orderpriority' END,
                  CASE WHEN o_totalprice IS DISTINCT FROM lag(o_totalprice) OVER w THEN 'o_totalprice' END) AS changed
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY lag(o_orderkey) OVER w IS NOT NULL""",
    ),
}
