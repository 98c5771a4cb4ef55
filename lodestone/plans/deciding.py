"""Queries of ordered decisions, scopes and lists: parts, lines and events stand for files, verdicts and calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.columns import six
from lodestone.sources.tables import table

#: The Danish names of the months.
MONTHS = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")


def release_gate(spark, sf):
    """The first rule that keeps a part from release, by order of the rules (FLT-9)."""
    rules = [("p_size > 45", "too_large"), ("p_retailprice < 950", "not_scanned"), ("p_type like 'PROMO%'", "withdrawn"), ("p_brand = 'Brand#11'", "brand_blocked")]
    reason = F.coalesce(*[F.when(F.expr(rule), F.lit(code)) for rule, code in rules], F.lit("none"))
    return table(spark, sf, "part").select("p_partkey", reason.alias("reason"))


def claim_eligibility(spark, sf):
    """What to do with each job by kind and status (FLT-11, JOIN-12)."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    decision = F.when(F.col("flag").isNull(), "wait").when((F.col("o_orderstatus") == "F") & (F.col("flag") == "R"), "cancel").when(F.col("o_orderstatus") == "P", "hold").otherwise("claim")
    return o.groupBy("o_orderstatus", decision.alias("decision")).agg(F.count("*").alias("n"))


def egress_parts(spark, sf):
    """An order leaves whole or not at all; the first line that keeps it and why (FLT-13)."""
    reason = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_discount") > 0.09, "discount").when(F.col("l_quantity") > 48, "quantity")
    lines = table(spark, sf, "lineitem").select("l_orderkey", reason.alias("reason"), F.struct("l_linenumber", "l_partkey").alias("place"))
    made = lines.groupBy("l_orderkey").agg(
        F.bool_and(F.col("reason").isNull()).alias("allowed"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).alias("first"),
    )
    return made.select("l_orderkey", "allowed", F.col("first.place.l_linenumber").alias("first_line"), F.col("first.reason").alias("reason"))


def production_conditions(spark, sf):
    """Conditions that a customer doesn't meet, in order, and the grade (FLT-16)."""
    checks = [("P1", "c_acctbal >= 0"), ("P2", "c_mktsegment <> 'HOUSEHOLD'"), ("P3", "c_nationkey < 20"), ("P4", "c_acctbal < 9000")]
    failed = F.array_compact(F.array(*[F.when(~F.expr(test), F.lit(name)) for name, test in checks]))
    grade = F.when(F.size(failed) == 0, "production").when(F.size(failed) == 1, "pilot").otherwise("none")
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws(",", failed).alias("unmet"), grade.alias("grade"))


def closed_keys(spark, sf):
    """Whether a JSON object has exactly the keys it may have (FLT-17)."""
    same = F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))
    return table(spark, sf, "events").groupBy("event_type", F.coalesce(same, F.lit(False)).alias("closed")).agg(F.count("*").alias("n"))


def file_checks(spark, sf):
    """The first failing rule of a page's file: empty, too large, no HTML head, or none; with its checksum (SRC-3)."""
    p = table(spark, sf, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    head = F.lower(F.substring("html", 1, 1024))
    reason = F.when(F.length("html") == 0, "empty").when(F.length("html") > 20000, "too_large").when(~head.contains("<html"), "no_head").otherwise("ok")
    return p.select("page_id", reason.alias("reason"), F.sha2("html", 256).alias("checksum"))


def file_duplicates(spark, sf):
    """How many other documents have a document's content (JOIN-9); counted once for each content, not by pairs."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return d.join(n, "h").select("doc_id", (F.col("n") - 1).alias("others"))


def first_chunk(spark, sf):
    """Each conversation's first turn (JOIN-11)."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("x"))
    return c.select("conv_id", "x.turn", "x.role", F.sha2("x.text", 256).alias("text_hash"))


def wildcard_passages(spark, sf):
    """Customers a rule names, or all of the segment where it names none: two joins on keys (JOIN-10)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rules = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 50 != 0, F.col("s_suppkey")).alias("only"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"))
    named = rules.filter("only is not null").join(c.withColumnRenamed("c_custkey", "only"), ["only", "c_mktsegment"]).select("s_suppkey", F.col("only").alias("c_custkey"))
    every = rules.filter("only is null").join(c, "c_mktsegment").select("s_suppkey", "c_custkey")
    return named.unionByName(every).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def heading_levels(spark, sf):
    """Dense levels of sizes within each brand, largest first (SRT-10): the distinct sizes of a brand are ranked, not its parts."""
    p = table(spark, sf, "part")
    sizes = p.select("p_brand", "p_size").distinct()
    ranked = sizes.select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("level"))
    return p.join(ranked, F.col("p_brand").eqNullSafe(F.col("b")) & F.col("p_size").eqNullSafe(F.col("s"))).select("p_partkey", "p_brand", "level")


def body_size(spark, sf):
    """Each brand's most frequent size by weight of its names' lengths, ties to the first seen (AGG-20)."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.sum(F.length("p_name")).alias("weight"), F.min("p_partkey").alias("seen"))
    made = p.groupBy("p_brand").agg(F.max_by("p_size", F.struct("weight", -F.col("seen"))).alias("size"), F.max("weight").alias("weight"))
    return made.select("p_brand", "size", "weight")


def table_lines(spark, sf):
    """Returned lines next to another returned line of the order; lone ones don't count (WIN-8)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    is_row = F.col("l_returnflag") == "R"
    beside = F.coalesce(F.lag(is_row).over(w), F.lit(False)) | F.coalesce(F.lead(is_row).over(w), F.lit(False))
    made = table(spark, sf, "lineitem").withColumn("kept", is_row & beside)
    return made.groupBy("l_orderkey").agg(F.count_if(is_row).alias("rows"), F.count_if("kept").alias("kept")).filter("rows > 0")


def run_classes(spark, sf):
    """Each order against the customer's order before: baseline, regression or none (EVL-3)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.lag("o_totalprice").over(w)
    kind = F.when(before.isNull(), "baseline").when(F.col("o_totalprice") < before * 0.5, "hard").when(F.col("o_totalprice") < before, "regression").otherwise("quality")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


def product_counts(spark, sf):
    """Nations with their number of suppliers, none included (APP-2, JOIN-14)."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean"))
    made = table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return made.select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"), six("mean").alias("mean"))


def predecessor_as_of(spark, sf):
    """Each purchase with the user's latest view before it (JOIN-7): one pass over a user's events, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf, "events").withColumn("view_id", view).filter("event_type = 'purchase'").select("event_id", "user_id", "view_id")


def permission_scopes(spark, sf):
    """The sorted segments each region's customers are in, and whether one is among them (FLT-4, AGG-3, AGG-4, ARR-3, JOIN-1)."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = c.filter("c_acctbal > 9500").groupBy("n_regionkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return made.select("n_regionkey", F.concat_ws(",", "s").alias("scopes"), F.array_contains("s", "BUILDING").alias("building"))


def verdicts(spark, sf):
    """An order's findings against the allowed ones, and the age of its last shipment (FLT-10, SET-4, DAT-9)."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("found"), F.to_date(F.max("l_shipdate")).alias("last"))
    extra = F.size(F.array_except("found", F.array(F.lit("A"), F.lit("N"))))
    verdict = F.when(F.col("last") < F.lit("1996-01-01").cast("date"), "stale").when(extra > 0, "rejected").when(F.size("found") > 1, "uncertain").otherwise("clean")
    return lines.select("l_orderkey", verdict.alias("verdict"))


def search_visibility(spark, sf):
    """Static rows but for the own group and, unless admin, hidden ones; then cases (FLT-8, SET-1)."""
    static = table(spark, sf, "part").filter("p_brand <> 'Brand#11' and p_size <= 40").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    cases = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.lit("case").alias("kind"), F.col("o_orderkey").alias("id"))
    return static.unionByName(cases)


def approved_scope(spark, sf):
    """Customers outside the approved scopes: by segment and nation in the pilot, by segment else (FLT-15)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_nationkey") < 10).alias("pilot"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"))
    pairs, types = s.distinct(), s.filter("c_nationkey < 5").select("c_mktsegment").distinct()
    pilot = c.filter("pilot").join(pairs, ["c_mktsegment", "c_nationkey"], "left_anti")
    return pilot.unionByName(c.filter("not pilot").join(types, "c_mktsegment", "left_anti").select(pilot.columns)).select("c_custkey", "pilot")


def type_minimums(spark, sf):
    """How many events each rule's types have, and whether that is enough; rules without one count as none (AGG-15)."""
    rules = spark.createDataFrame([("reading", ["view", "click"], 100), ("buying", ["purchase"], 10_000_000), ("refunds", ["refund"], 1)], "rule string, types array<string>, least int")
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    made = rules.select("rule", "least", F.explode("types").alias("event_type")).join(n, "event_type", "left")
    return made.groupBy("rule", "least").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("rule", "n", (F.col("n") >= F.col("least")).alias("met"))


def latest_error(spark, sf):
    """Each user's latest error (AGG-18)."""
    made = table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return made.select("user_id", "x.event_id", "x.value")


def newest_list(spark, sf):
    """The 50 newest orders (SRT-9); the limit is the list's."""
    o = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    return o.select("o_orderkey", "o_orderdate")


def shown_dates(spark, sf):
    """Dates as Danish readers write them; an interval's end is shown as the day before (DAT-8)."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    end = F.date_sub(F.date_add(F.to_date("o_orderdate"), 60), 1)
    said = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(". "), F.element_at(months, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", said.alias("from_long"), F.date_format(end, "dd.MM.yyyy").alias("to_short"))


QUERIES = {
    "release_gate": (
        release_gate,
        """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'too_large' WHEN p_retailprice < 950 THEN 'not_scanned' WHEN p_type LIKE 'PROMO%' THEN 'withdrawn'
                  WHEN p_brand = 'Brand#11' THEN 'brand_blocked' ELSE 'none' END AS reason FROM part""",
    ),
    "claim_eligibility": (
        claim_eligibility,
        """SELECT o_orderstatus, CASE WHEN flag IS NULL THEN 'wait' WHEN o_orderstatus = 'F' AND flag = 'R' THEN 'cancel' WHEN o_orderstatus = 'P' THEN 'hold' ELSE 'claim' END AS decision, count(*) AS n
           FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    ),
    "egress_parts": (
        egress_parts,
        """WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.09 THEN 'discount' WHEN l_quantity > 48 THEN 'quantity' END AS why FROM lineitem),
           f AS (SELECT l_orderkey, l_linenumber, why FROM l WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, why) = 1)
           SELECT o.l_orderkey, f.why IS NULL AS allowed, f.l_linenumber AS first_line, f.why AS reason FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f ON f.l_orderkey = o.l_orderkey""",
    ),
    "production_conditions": (
        production_conditions,
        """SELECT c_custkey, array_to_string(u, ',') AS unmet, CASE len(u) WHEN 0 THEN 'production' WHEN 1 THEN 'pilot' ELSE 'none' END AS grade FROM (
             SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'P1' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'P2' END, CASE WHEN c_nationkey >= 20 THEN 'P3' END,
                    CASE WHEN c_acctbal >= 9000 THEN 'P4' END], lambda x: x IS NOT NULL) AS u FROM customer)""",
    ),
    "closed_keys": (
        closed_keys,
        "SELECT event_type, coalesce(list_sort(json_keys(props)) = ['k'], false) AS closed, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "file_checks": (
        file_checks,
        """SELECT page_id, CASE WHEN length(h) = 0 THEN 'empty' WHEN length(h) > 20000 THEN 'too_large' WHEN NOT contains(lower(h[1:1024]), '<html') THEN 'no_head' ELSE 'ok' END AS reason, sha256(h) AS checksum
           FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""",
    ),
    "file_duplicates": (
        file_duplicates,
        "SELECT doc_id, count(*) OVER (PARTITION BY coalesce(text, '')) - 1 AS others FROM documents QUALIFY count(*) OVER (PARTITION BY coalesce(text, '')) > 1",
    ),
    "first_chunk": (
        first_chunk,
        "SELECT conv_id, turn, role, sha256(text) AS text_hash FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1",
    ),
    "wildcard_passages": (
        wildcard_passages,
        """SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first FROM supplier JOIN customer
             ON c_mktsegment = CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AND (s_suppkey % 50 = 0 OR c_custkey = s_suppkey) GROUP BY 1""",
    ),
    "heading_levels": (heading_levels, "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS level FROM part"),
    "body_size": (
        body_size,
        """SELECT p_brand, p_size AS size, CAST(weight AS BIGINT) AS weight FROM (SELECT p_brand, p_size, sum(length(p_name)) AS weight, min(p_partkey) AS seen FROM part GROUP BY 1, 2)
           QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, seen) = 1""",
    ),
    "table_lines": (
        table_lines,
        """SELECT l_orderkey, count(*) FILTER (WHERE r) AS rows, count(*) FILTER (WHERE r AND (coalesce(a, false) OR coalesce(b, false))) AS kept FROM (
             SELECT l_orderkey, l_returnflag = 'R' AS r, lag(l_returnflag = 'R') OVER w AS a, lead(l_returnflag = 'R') OVER w AS b
             FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) GROUP BY 1 HAVING count(*) FILTER (WHERE r) > 0""",
    ),
    "run_classes": (
        run_classes,
        """SELECT o_orderkey, CASE WHEN b IS NULL THEN 'baseline' WHEN o_totalprice < b * 0.5 THEN 'hard' WHEN o_totalprice < b THEN 'regression' ELSE 'quality' END AS kind
           FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)""",
    ),
    "product_counts": (
        product_counts,
        "SELECT n_name, count(s_suppkey) AS suppliers, floor(avg(s_acctbal) * 1e6 + 0.5) / 1e6 AS mean FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name",
    ),
    "predecessor_as_of": (
        predecessor_as_of,
        """SELECT event_id, user_id, view_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER
             (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) WHERE event_type = 'purchase'""",
    ),
    "permission_scopes": (
        permission_scopes,
        """SELECT n_regionkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS scopes, bool_or(c_mktsegment = 'BUILDING') AS building
           FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 GROUP BY 1""",
    ),
    "verdicts": (
        verdicts,
        """SELECT l_orderkey, CASE WHEN max(l_shipdate) < TIMESTAMP '1996-01-01' THEN 'stale' WHEN bool_or(l_returnflag NOT IN ('A', 'N')) THEN 'rejected'
                  WHEN count(DISTINCT l_returnflag) > 1 THEN 'uncertain' ELSE 'clean' END AS verdict FROM lineitem GROUP BY 1""",
    ),
    "search_visibility": (
        search_visibility,
        "SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_brand <> 'Brand#11' AND p_size <= 40 UNION ALL SELECT 'case', o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    ),
    "approved_scope": (
        approved_scope,
        """WITH s AS (SELECT s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS t FROM supplier)
           SELECT c_custkey, c_nationkey < 10 AS pilot FROM customer
           WHERE CASE WHEN c_nationkey < 10 THEN (c_nationkey, c_mktsegment) NOT IN (SELECT (n, t) FROM s) ELSE c_mktsegment NOT IN (SELECT t FROM s WHERE n < 5) END""",
    ),
    "type_minimums": (
        type_minimums,
        """SELECT rule, count(event_id) AS n, count(event_id) >= least AS met
           FROM (VALUES ('reading', 'view', 100), ('reading', 'click', 100), ('buying', 'purchase', 10000000), ('refunds', 'refund', 1)) r(rule, t, least)
           LEFT JOIN events ON event_type = t GROUP BY rule, least""",
    ),
    "latest_error": (
        latest_error,
        "SELECT user_id, event_id, value FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "newest_list": (newest_list, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"),
    "shown_dates": (
        shown_dates,
        f"""SELECT o_orderkey, day(o_orderdate) || '. ' || ({list(MONTHS)})[month(o_orderdate)] || ' ' || year(o_orderdate) AS from_long,
                   strftime(CAST(o_orderdate AS DATE) + 59, '%d.%m.%Y') AS to_short FROM orders""",
    ),
}
