"""Queries of evaluation and operation. Events stand for calls of the service, orders for jobs."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import gain, six, squeezed, wilson
from lodestone.operators import operations as o
from lodestone.operators.ordered import ranks, sorted_list
from lodestone.operators.seeds import occurrences
from lodestone.sources.tables import add_batch, json_lines, shared_path, table

NOW = datetime.datetime(1999, 1, 1)
GATES = [("Q1", "recall", ">=", 0.95), ("Q3", "mrr", ">=", 0.70), ("Q6", "intrusion", "<=", 0.10)]


def wilson_by_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    made = d.groupBy("source").agg(F.sum(F.col("quality").cast("bigint")).alias("good"), F.count("quality").alias("n"))
    low, high = wilson("good", "n")
    return made.select("source", "good", "n", six(F.col("good") / F.col("n")).alias("value"), six(low).alias("low"), six(high).alias("high"))


def _occurrences(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", squeezed("text").alias("text"))
    items = table(spark, sf, "benchmark").select("item_id", squeezed("text").alias("pattern"))
    return occurrences(docs, items, "doc_id", "item_id")


def found_passages(spark, sf) -> DataFrame:
    """(item_id, doc_id, rank): documents that hold a benchmark passage, white space aside (STR-10 without its
    rule that an anchor occurs once; every document with it is a hit)."""
    hits = _occurrences(spark, sf).select("item_id", "doc_id").distinct()
    return hits.select("item_id", "doc_id", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")).alias("rank"))


def anchor_counts(spark, sf):
    """How often each passage occurs in all documents, overlaps counted, and whether it is an anchor: exactly once (STR-10)."""
    n = _occurrences(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    items = table(spark, sf, "benchmark").select("item_id")
    zero = F.lit(0).cast("bigint")
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("n", zero).alias("n"), F.coalesce("documents", zero).alias("documents"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("anchor"))


def passage_hits(spark, sf):
    return found_passages(spark, sf)


def _measured(spark, sf) -> DataFrame:
    hits, items = found_passages(spark, sf), table(spark, sf, "benchmark").select("item_id")
    first = hits.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("rank <= 8")
    grade = F.when(F.col("lang") == "en", 3).otherwise(1)
    per = first.groupBy("item_id").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", grade.alias("grade")))).alias("g"))
    per = items.join(per, "item_id", "left").withColumn("grades", F.coalesce(F.transform("g", lambda x: x.grade), F.array().cast("array<int>")))
    ideal = gain(F.reverse(F.array_sort("grades")))
    return per.withColumn("ndcg", F.when(ideal == 0, 0.0).otherwise(gain("grades") / ideal))


def retrieval_metrics(spark, sf):
    made = _measured(spark, sf).agg(
        F.count("*").alias("cases"),
        F.count("first").alias("found"),
        six(F.count("first") / F.count("*")).alias("recall"),
        six(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        six(F.avg("ndcg")).alias("ndcg"),
    )
    return made


def gates_verdict(spark, sf):
    m = _measured(spark, sf).agg(F.count("*").alias("cases"), F.count("first").alias("found"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
    low, high = wilson("found", "cases")
    none = F.lit(None).cast("double")
    values = {"Q1": (F.col("found") / F.col("cases"), low, high), "Q3": (F.col("mrr"), none, none), "Q6": (none, none, none)}
    rows = [F.struct(F.lit(g).alias("gate"), v.alias("value"), a.alias("low"), b.alias("high"), F.lit(c).alias("comparator"), F.lit(t).alias("threshold")) for g, _, c, t in GATES for v, a, b in [values[g]]]
    return o.decided(m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")).select("gate", six("value").alias("value"), "threshold", "result")


def hard_gate_counts(spark, sf):
    gate = F.when(F.col("event_type") == "error", F.concat(F.lit("H"), (F.col("user_id") % 5 + 1).cast("string")))
    return o.counted_gates(table(spark, sf, "events").select(gate.alias("gate")).filter("gate is not null"))


def nearest_rank(spark, sf):
    """AGG-12, WIN-4."""
    made = ranks(table(spark, sf, "events"), ["event_type"], "value", [0.5, 0.95])
    p = [F.max(F.when(F.col("p") == q, F.col("value"))).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("t")).agg(F.count("*").alias("n"))
    made = made.groupBy("event_type").agg(*p)
    return n.join(made, F.col("t").eqNullSafe(F.col("event_type")), "left").select(F.col("t").alias("event_type"), "n", "p50", "p95")


def perf_targets(spark, sf):
    """AGG-13: all seven targets. Events are steps of retrieval, their values tens of milliseconds; orders are documents whose lines are
    pages by ten."""
    e, lines = table(spark, sf, "events"), table(spark, sf, "lineitem")
    step = F.when(F.col("event_type") == "view", "total").when(F.col("event_type") == "click", "embedding").when(F.col("event_type") == "purchase", "search")
    documents = lines.groupBy("l_orderkey").agg((F.count("*") * 10).alias("pages"), (F.sum("l_quantity") * 2).alias("seconds"))
    corpus = lines.agg(F.count("*").alias("pages"), (F.sum("l_quantity") / 100).alias("seconds"))
    made = o.performance(e.select(step.alias("step"), F.floor(F.col("value") * 10).alias("ms")).filter("step is not null"), documents, corpus)
    return made.select("target", "limit", six("value").alias("value"), "status")


def windowed_rate(spark, sf):
    made = o.rates(table(spark, sf, "events"), F.col("event_type") == "error", "6 hours", 20)
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "failed", six("rate").alias("rate"))


def windowed_p95(spark, sf):
    events = table(spark, sf, "events").select(o.windowed(None, "6 hours").start.cast("timestamp_ntz").alias("window_start"), "value")
    made = ranks(events, ["window_start"], "value", [0.95])
    return made.filter("n >= 20").select("window_start", "n", F.col("value").alias("p95"))


def edge_alarms(spark, sf):
    hours = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg((F.max("value") > 150).alias("active"))
    return o.edges(hours, "event_type", "hour", "active").select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "change")


def event_log(spark, sf):
    """Events as JSON lines in four batches, of which one comes twice, and lines that are none; read back with their numbers
    (SRC-4, SRC-11, JSN-2): by type the events and values, by null the lines that are no events."""
    path = shared_path(spark, f"events_{uuid.uuid4().hex}")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    for n in (0, 1, 2, 3, 1):
        add_batch(e.filter(F.pmod("event_id", F.lit(4)) == n), n, path)
    e.filter("event_id % 100 = 0").select(F.concat(F.lit("{broken "), "event_id").alias("value")).withColumn("batch", F.lit(9)).write.mode("append").partitionBy("batch").text(path)
    made = json_lines(spark, path, e.schema)
    each = made.groupBy("file").agg(F.max("line").alias("n"), F.countDistinct("line").alias("lines"))
    good = each.agg(F.coalesce(F.bool_and(F.col("n") == F.col("lines")), F.lit(True)).alias("numbered"))
    return made.groupBy("event_type").agg(F.count("*").alias("n"), F.count("problem").alias("problems"), six(F.sum("value")).alias("total")).crossJoin(good)  # one row


def sorted_customers(spark, sf):
    """Customers in a list by segment, then balance, the highest first (SRT-7)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return sorted_list(c, [("c_mktsegment", False), ("balance", True)], "c_custkey").select("c_custkey", "position")


def alert_cooldown(spark, sf):
    alerts = table(spark, sf, "events").filter("event_type = 'error'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return o.cooled_down(alerts, "user_id", "ts", 6 * 3600).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def queue_snapshot(spark, sf):
    """Jobs by status, which are claimable now, the oldest's age in days, and the next (AGG-1, AGG-16, SRT-8)."""
    jobs = table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    open_now = (F.col("o_orderstatus") == "O") & (F.col("at") <= F.lit(NOW))
    return jobs.agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("queued"),
        F.count_if(F.col("o_orderstatus") == "P").alias("running"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(open_now).alias("claimable"),
        F.datediff(F.lit(NOW.date()), F.min(F.when(open_now, F.to_date("at")))).cast("bigint").alias("oldest_days"),
        F.min(F.when(open_now, F.struct("at", "o_orderkey")))["o_orderkey"].alias("next_job"),
    )


def health_snapshot(spark, sf):
    """Failures by code and what the last day had (AGG-2, AGG-25, DAT-7, JOIN-13)."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("now"))
    e = e.join(F.broadcast(last))  # one row
    day = F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(day).alias("last_day"), F.max("value").alias("highest"), F.countDistinct("user_id").alias("users"))


def latest_per_group(spark, sf):
    """AGG-17."""
    made = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return made.select("o_custkey", "x.o_orderdate", "x.o_orderkey", "x.o_orderstatus")


def newest_n(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("o_custkey", "o_orderkey", "n")


def budget_prefix(spark, sf):
    """Turns of a conversation that fit a budget of characters, up to the first that doesn't (EVL-6)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.least(F.length("text"), F.lit(2000))
    made = table(spark, sf, "conversations").select("conv_id", "turn", size.alias("size"), F.sum(size).over(w).alias("total"))
    return made.filter("total <= 1500")


def ordered_nested(spark, sf):
    """AGG-30, ARR-4."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    parts = F.concat_ws(",", F.transform("x", lambda s: s.l_partkey.cast("string")))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.coalesce(parts, F.lit("")).alias("parts"))


def json_paths(spark, sf):
    """ARR-1, JSN-1."""
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))
    return e.groupBy("event_type", "keys").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k").isNull()).alias("missing"))


_HITS = r"""
d AS (SELECT doc_id, lang, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM documents),
b AS (SELECT item_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS passage FROM benchmark),
h AS (SELECT item_id, doc_id, lang, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INTEGER) AS rank
      FROM b JOIN d ON contains(body, passage) AND passage <> '')
"""
_MEASURED = f"""
{_HITS},
g AS (SELECT item_id, min(rank) AS first, list(CASE WHEN lang = 'en' THEN 3 ELSE 1 END ORDER BY rank) AS grades FROM h WHERE rank <= 8 GROUP BY item_id),
m AS (SELECT item_id, first,
             list_sum(list_transform(grades, lambda g, i: (pow(2.0, g) - 1) / log2(i + 1.0))) AS dcg,
             list_sum(list_transform(list_reverse_sort(grades), lambda g, i: (pow(2.0, g) - 1) / log2(i + 1.0))) AS ideal
      FROM b LEFT JOIN g USING (item_id))
"""
_WILSON = "(({k}/{n} + 1.959963984540054*1.959963984540054/(2*{n})) / (1 + 1.959963984540054*1.959963984540054/{n}) {s} 1.959963984540054/(1 + 1.959963984540054*1.959963984540054/{n}) * sqrt({k}/{n}*(1-{k}/{n})/{n} + 1.959963984540054*1.959963984540054/(4*{n}*{n})))"
_LOW, _HIGH = _WILSON.replace("{s}", "-"), _WILSON.replace("{s}", "+")
_SIX = "floor(({}) * 1e6 + 0.5) / 1e6"
QUERIES = {
    "wilson_by_source": (
        wilson_by_source,
        f"""SELECT source, good, n, {_SIX.format('k / m')} AS value,
                   {_SIX.format('CASE WHEN k = 0 THEN 0.0 ELSE greatest(0.0, ' + _LOW.format(k='k', n='m') + ') END')} AS low,
                   {_SIX.format('CASE WHEN k = m THEN 1.0 ELSE least(1.0, ' + _HIGH.format(k='k', n='m') + ') END')} AS high
            FROM (SELECT source, CAST(sum(quality) AS BIGINT) AS good, count(quality) AS n, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(quality) AS DOUBLE) AS m
                  FROM documents JOIN labels USING (doc_id) GROUP BY source)""",
    ),
    "anchor_counts": (
        anchor_counts,
        r"""WITH b AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM documents),
                 i AS (SELECT item_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS p FROM benchmark),
                 h AS (SELECT item_id, doc_id, len(list_filter(range(1, length(body) - length(p) + 2), lambda j: substr(body, j, length(p)) = p)) AS n FROM b JOIN i ON contains(body, p) WHERE p <> '')
            SELECT item_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, count(doc_id) AS documents, coalesce(sum(n), 0) = 1 AS anchor FROM i LEFT JOIN h USING (item_id) GROUP BY item_id""",
    ),
    "passage_hits": (passage_hits, f"WITH {_HITS} SELECT item_id, doc_id, rank FROM h"),
    "retrieval_metrics": (
        retrieval_metrics,
        f"""WITH {_MEASURED} SELECT count(*) AS cases, count(first) AS found, {_SIX.format('count(first) / count(*)')} AS recall,
            {_SIX.format('avg(coalesce(1.0::DOUBLE / first, 0))')} AS mrr, {_SIX.format('avg(CASE WHEN coalesce(ideal, 0) = 0 THEN 0.0 ELSE dcg / ideal END)')} AS ndcg FROM m""",
    ),
    "gates_verdict": (
        gates_verdict,
        f"""WITH {_MEASURED}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(first) AS DOUBLE) AS k, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM m)
            SELECT 'Q1' AS gate, {_SIX.format('k / n')} AS value, 0.95::DOUBLE AS threshold,
                   CASE WHEN k / n >= 0.95 - 1e-9 AND (CASE WHEN k = 0 THEN 0.0 ELSE {_LOW.format(k='k', n='n')} END) < 0.95 AND (CASE WHEN k = n THEN 1.0 ELSE {_HIGH.format(k='k', n='n')} END) > 0.95 THEN 'uncertain'
                        WHEN k / n >= 0.95 - 1e-9 THEN 'pass' ELSE 'fail' END AS result FROM a
            UNION ALL SELECT 'Q3', {_SIX.format('mrr')}, 0.7::DOUBLE, CASE WHEN mrr >= 0.7 - 1e-9 THEN 'pass' ELSE 'fail' END FROM a
            UNION ALL SELECT 'Q6', NULL, 0.1::DOUBLE, 'not_measured'""",
    ),
    "hard_gate_counts": (
        hard_gate_counts,
        "SELECT gate, count(user_id) AS n FROM (SELECT 'H' || i AS gate FROM range(1, 8) t(i)) LEFT JOIN events ON event_type = 'error' AND gate = 'H' || (user_id % 5 + 1) GROUP BY gate",
    ),
    "nearest_rank": (nearest_rank, "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
    "perf_targets": (
        perf_targets,
        f"""WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'total' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'search' END AS step, floor(value * 10) AS ms FROM events),
                 r AS (SELECT step, ms, row_number() OVER (PARTITION BY step ORDER BY ms) AS i, count(*) OVER (PARTITION BY step) AS n FROM e WHERE step IS NOT NULL AND ms IS NOT NULL),
                 t AS (SELECT * FROM (VALUES ('retrieval_total_p50', 'total', 50, 800.0::DOUBLE), ('retrieval_total_p95', 'total', 95, 1500.0), ('query_embedding_p95', 'embedding', 95, 300.0), ('search_p95', 'search', 95, 300.0),
                                             ('rerank_p95', 'rerank', 95, 500.0)) t(target, step, p, lim)),
                 d AS (SELECT count(*) * 10 AS pages, sum(l_quantity) * 2 AS seconds FROM lineitem GROUP BY l_orderkey),
                 a AS (SELECT target, lim, (SELECT max(ms) FROM r WHERE r.step = t.step AND i = (p * n + 99) // 100) AS value FROM t
                       UNION ALL SELECT 'ingestion_50_pages_seconds', 300, max(seconds) FILTER (WHERE pages >= 50) FROM d
                       UNION ALL SELECT 'ingestion_corpus_2000_pages_seconds', 14400, CASE WHEN count(*) >= 2000 THEN sum(l_quantity) / 100 END FROM lineitem)
            SELECT target, lim AS "limit", {_SIX.format("value")} AS value, CASE WHEN value IS NULL THEN 'not_measured' WHEN value <= lim THEN 'met' ELSE 'not_met' END AS status FROM a""",
    ),
    "windowed_rate": (
        windowed_rate,
        f"""SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed,
                   {_SIX.format("count(*) FILTER (WHERE event_type = 'error') / count(*)")} AS rate FROM events GROUP BY 1 HAVING count(*) >= 20""",
    ),
    "windowed_p95": (windowed_p95, "SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1 HAVING count(*) >= 20"),
    "edge_alarms": (
        edge_alarms,
        """SELECT event_type, hour, CASE WHEN active THEN 'raised' ELSE 'cleared' END AS change FROM (
             SELECT *, coalesce(lag(active) OVER (PARTITION BY event_type ORDER BY hour), false) AS old FROM (
               SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, max(value) > 150 AS active FROM events GROUP BY 1, 2)) WHERE old <> active""",
    ),
    "event_log": (
        event_log,
        f"""SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS problems, {_SIX.format("sum(value)")} AS total, true AS numbered FROM events GROUP BY event_type
            UNION ALL SELECT NULL, count(*), count(*), NULL, true FROM events WHERE event_id % 100 = 0 HAVING count(*) > 0""",
    ),
    "sorted_customers": (
        sorted_customers,
        """SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS position FROM customer""",
    ),
    "alert_cooldown": (
        alert_cooldown,
        """WITH RECURSIVE a AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'error'),
           k AS (SELECT user_id, min(ts) AS ts FROM a GROUP BY user_id
                 UNION ALL
                 SELECT k.user_id, (SELECT min(a.ts) FROM a WHERE a.user_id = k.user_id AND a.ts >= k.ts + INTERVAL 6 HOUR) FROM k WHERE k.ts IS NOT NULL)
           SELECT user_id, ts FROM k WHERE ts IS NOT NULL""",
    ),
    "queue_snapshot": (
        queue_snapshot,
        """SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
                  count(*) FILTER (WHERE c) AS claimable, CAST(DATE '1999-01-01' - min(CAST(o_orderdate AS DATE)) FILTER (WHERE c) AS BIGINT) AS oldest_days,
                  (arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE c)) AS next_job
           FROM (SELECT *, o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1999-01-01' AS c FROM orders)""",
    ),
    "health_snapshot": (
        health_snapshot,
        """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day, max(value) AS highest, count(DISTINCT user_id) AS users
           FROM events GROUP BY 1""",
    ),
    "latest_per_group": (
        latest_per_group,
        "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    ),
    "newest_n": (
        newest_n,
        "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5",
    ),
    "budget_prefix": (
        budget_prefix,
        """SELECT * FROM (SELECT conv_id, turn, CAST(least(length(text), 2000) AS INTEGER) AS size,
             CAST(sum(least(length(text), 2000)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM conversations) WHERE total <= 1500""",
    ),
    "ordered_nested": (
        ordered_nested,
        """SELECT o_orderkey, o_orderstatus, coalesce(parts, '') AS parts FROM orders LEFT JOIN (
             SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    ),
    "json_paths": (
        json_paths,
        """SELECT event_type, keys, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, count(*) FILTER (WHERE k IS NULL) AS missing FROM (
             SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events) GROUP BY 1, 2""",
    ),
}
