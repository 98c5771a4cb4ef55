"""Queries of evaluation runs: orders are cases, their lines what was returned and what is expected, parts the texts of
documents' versions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import Z95, six
from lodestone.operators import evaluation as e
from lodestone.operators import observation as ob
from lodestone.sources.tables import bucketed, table

TODAY = datetime.date(1999, 6, 1)
NEUTRAL = "a source you can't see says otherwise"
WANTED = ob.Configuration("model@1", "cross", "2", ["structure/1"], NEUTRAL)
TYPES = ["direct", "multi_chunk", "unanswerable", "historical", "conflict", "distractor", "permission"]


def _name(n: Column, prefix: str = "document-") -> Column:
    return F.concat(F.lit(prefix), F.lpad((n % 100).cast("string"), 4, "0"))


def _described(parts: DataFrame, n: Column) -> DataFrame:
    version = F.concat(F.lit("v"), (F.floor(n / 100) % 2 + 1).cast("string"))
    return parts.select("*", (n % 100).alias("doc"), _name(n).alias("document"), version.alias("version"), F.concat_ws(" of ", "p_name", "p_brand").alias("phrase"))


def _parts(spark, sf) -> DataFrame:
    return _described(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_partkey"))


def _orders(spark, sf) -> DataFrame:
    n = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (n % 7 + 1).cast("int"))
    orders = table(spark, sf, "orders").select(n.alias("case"), "o_custkey", kind.alias("type"), F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice")
    return orders.withColumn("day", F.when(F.col("type") == "historical", F.col("day")))


def _stored(spark, sf, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines with their parts, and orders, each shuffled by case once and written in buckets of it. A line is an item, which has its
    places by price and in the order of lines, or an expected passage, or both; unless whole, only items by price are made."""
    kept, hoped = F.coalesce(F.col("l_discount") <= 0.06, F.lit(False)), F.coalesce(F.col("l_quantity") > 25, F.lit(False)) if whole else F.lit(False)
    of_line = [F.col("l_orderkey").alias("case"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"]
    lines = table(spark, sf, "lineitem").select(*of_line, (F.col("l_tax") > 0.07).alias("taxed"), (F.col("l_quantity") > 49).alias("over"), kept.alias("kept"), hoped.alias("hoped")).filter("kept or hoped")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf, "lineitem").count() >> 19)

    def place(first: Column) -> Column:
        order = Window.partitionBy("case", "kept").orderBy(first, "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
        return F.when(F.col("kept"), F.row_number().over(order))

    placed = lines.join(parts, "l_partkey").repartition(buckets, "case").withColumn("by_price", place(F.desc("l_extendedprice")))
    if whole:
        placed = placed.withColumn("by_line", place(F.col("l_linenumber")))
    made = _described(placed, F.col("l_partkey")).drop("doc", "phrase", "l_partkey", "l_suppkey", "l_extendedprice")
    return bucketed(made, "case", buckets), bucketed(_orders(spark, sf), "case", buckets)


def _cases(orders: DataFrame) -> DataFrame:
    return orders.select(
        "case", F.concat(F.lit("a"), (F.col("o_custkey") % 5).cast("string")).alias("actor"), "type", F.when(F.col("type").isin("unanswerable", "permission"), "insufficient").otherwise("evidence").alias("outcome"),
        F.when(F.col("type") == "historical", "as_of").otherwise("current").alias("mode"), F.col("day").alias("as_of"),
        F.when(F.col("case") % 11 == 0, F.array(F.lit("ECONOMY"), F.lit("STANDARD"))).alias("products"), F.when(F.col("case") % 12 == 0, F.array(F.lit("Brand#1"), F.lit("Brand#2"))).alias("types"),
        F.when(F.col("case") % 13 == 0, F.array(_name(F.col("o_custkey")))).alias("documents"),
    )


def _facit(spark, sf, lines: DataFrame, orders: DataFrame) -> ob.Facit:
    parts = _parts(spark, sf)
    docs = parts.select("doc", "document").distinct()
    texts = parts.groupBy("doc", "document", "version").agg(F.array_join(F.array_sort(F.collect_set("phrase")), ". ").alias("text"))
    first, change = F.col("version") == "v1", F.date_add(F.lit("1998-01-01").cast("date"), F.col("doc").cast("int"))
    begin = F.when(first, F.date_add(F.lit("1995-01-01").cast("date"), F.col("doc").cast("int"))).otherwise(F.date_add(change, F.when(F.col("doc") % 13 == 0, 100).otherwise(0)))
    versions = texts.select(
        "document", "version", F.when(first, 0).otherwise(1).alias("nth"), F.when(~first & (F.col("doc") % 17 == 0), "withdrawn").otherwise("published").alias("status"),
        begin.alias("valid_from"), F.when(first, change).alias("valid_to"), "text",
    )
    who = docs.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("(doc + a) % 3 <> 0")
    grants = who.select(F.concat(F.lit("a"), F.col("a").cast("string")).alias("actor"), "document", ((F.col("doc") + F.col("a")) % 2 == 0).alias("historical"))
    conflicts = docs.filter("doc % 10 = 0").select(_name(F.col("doc"), "conflict-").alias("conflict"), F.when(F.col("doc") % 20 == 0, "open").otherwise("closed").alias("status"), F.col("document").alias("left"), _name(F.col("doc") + 1).alias("right"))
    ids = docs.select("document", F.lit("id").alias("label"), F.col("document").alias("marker"))
    marks = [conflicts.select(F.col(side).alias("document"), F.lit("conflict").alias("label"), F.col("conflict").alias("marker")) for side in ("left", "right")]
    expected = lines.filter("hoped").select("case", F.col("l_linenumber").alias("passage"), "document", "version", F.col("p_name").alias("anchor"), (F.col("l_linenumber") % 3 + 1).alias("grade"))
    anyone = F.lit(None).cast("string").alias("version")
    excluded = orders.filter("case % 9 = 0").select("case", _name(F.col("o_custkey")).alias("document"), anyone)
    distractors = orders.filter("type = 'distractor'").select("case", _name(F.col("o_custkey") + 1).alias("document"), anyone)
    return ob.Facit(_cases(orders), grants, versions, conflicts, ids.unionByName(marks[0]).unionByName(marks[1]), expected, excluded, distractors)


def _items(lines: DataFrame, rank: str = "by_price") -> DataFrame:
    keys = F.array(F.lit("message"), F.lit("visibility"))
    neutral = F.struct(F.lit("restricted").alias("visibility"), keys.alias("keys"), F.when(F.col("taxed"), "other").otherwise(NEUTRAL).alias("message"))
    visible = F.struct(F.lit("visible").alias("visibility"), F.array(F.lit("conflict")).alias("keys"), F.lit(None).cast("string").alias("message"))
    marks = F.when(F.col("l_returnflag") == "R", F.array(visible)).when(F.col("l_returnflag") == "N", F.array(neutral)).otherwise(F.array().cast("array<struct<visibility:string,keys:array<string>,message:string>>"))
    return lines.filter("kept").select(
        "case", F.col(rank).alias("rank"), "document", F.when(F.col("l_linenumber") != 7, F.col("version")).alias("version"), F.concat_ws(" of ", "p_name", "p_brand").alias("text"),
        F.lit(None).cast("string").alias("lead_in"), F.col("p_type").alias("product"), F.col("p_brand").alias("document_type"), F.when(F.col("l_linestatus") == "F", "historical").otherwise("current").alias("temporal_status"),
        marks.alias("marks"), F.array(F.when(F.col("over"), "old").otherwise("structure/1")).alias("chunkers"),
    )


def _runs(lines: DataFrame, orders: DataFrame) -> DataFrame:
    told = _items(lines).groupBy("case").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "document", "text")))).alias("told"))
    o = orders.join(told, "case", "left")
    debug = F.when(F.col("case") % 10 == 0, _name(F.col("o_custkey"))), F.when(F.col("case") % 20 == 0, F.concat(F.lit("conflict-"), F.lpad((F.floor(F.col("o_custkey") / 10) % 10 * 10).cast("string"), 4, "0")))
    none = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return o.select(
        "case", F.when(F.col("type") == "historical", "as_of").otherwise("current").alias("mode"), F.date_add("day", F.when(F.col("case") % 50 == 3, 1).otherwise(0)).alias("as_of"),
        F.concat_ws(" ", "told", *debug).alias("raw"), (F.col("o_orderpriority") == "5-LOW").alias("dev_override"), F.when(none, "none").otherwise("cross").alias("reranker"), F.lit("2").alias("reranker_version"),
        F.when(none, "development").otherwise("production").alias("reranker_grade"), F.when(F.col("o_totalprice") >= 20000, "model@1").alias("model"), F.lit("production").alias("model_grade"),
    )


def _breaches(spark, sf, lines: DataFrame, orders: DataFrame) -> DataFrame:
    return ob.breaches(_items(lines), _runs(lines, orders), _facit(spark, sf, lines, orders), WANTED, TODAY)


def case_breaches(spark, sf):
    """Breaches of the hard gates, case by case (EVL-1)."""
    return _breaches(spark, sf, *_stored(spark, sf, whole=False)).groupBy("case", "gate", "code").agg(F.count("*").alias("n"), F.min("rank").alias("first"))


def case_observations(spark, sf):
    """EVL-1, SRT-11."""
    lines, orders = _stored(spark, sf)
    made = ob.observations(_items(lines), _facit(spark, sf, lines, orders))
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("gains", "ideal")]
    return made.select("case", "type", "outcome", "item_count", "items_within_k", "source_rank", "first_grade3_rank", "required_covered", "required_total", "distractor_items", *lists)


def _metrics(spark, sf, lines: DataFrame, orders: DataFrame, rank: str = "by_price") -> DataFrame:
    return ob.metrics(ob.observations(_items(lines, rank), _facit(spark, sf, lines, orders)))


def run_metrics(spark, sf):
    """EVL-2, AGG-6 to AGG-11."""
    return _metrics(spark, sf, *_stored(spark, sf)).select("metric", "numerator", "denominator", *[six(x).alias(x) for x in ("value", "low", "high")])


def _gates(spark, sf, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The run ranked by price against the same without a reranker, in the order of lines."""
    return ob.quality_gates(_metrics(spark, sf, lines, orders), _metrics(spark, sf, lines, orders, "by_line"))


def quality_gate_results(spark, sf):
    """Q1 to Q7, with the comparison of both runs (EVL-2, AGG-26)."""
    return _gates(spark, sf, *_stored(spark, sf)).select("gate", "metric", six("value").alias("value"), "threshold", "status", "uncertain")


def case_minimums(spark, sf):
    """AGG-15: all six rules."""
    return e.minimums(_cases(_orders(spark, sf))).select("rule", "least", "n", "met")


def run_verdict(spark, sf):
    """AGG-27, with every gate."""
    lines, orders = _stored(spark, sf)
    cases = _cases(orders)
    return ob.decision(_breaches(spark, sf, lines, orders).select("gate"), _gates(spark, sf, lines, orders), e.minimums(cases), cases)


def report_mismatches(spark, sf):
    """AGG-28: a report with one wrong number, one missing and one too many."""
    new = _metrics(spark, sf, *_stored(spark, sf)).select("metric", "value")
    old = new.filter("metric <> 'mrr_at_k'").withColumn("value", F.when(F.col("metric") == "ndcg_at_k", F.col("value") + 0.25).otherwise(F.col("value")))
    extra = old.filter("metric = 'ndcg_at_k'").select(F.lit("unknown").alias("metric"), F.lit(1.0).alias("value"))
    made = e.mismatches(old.unionByName(extra), new)
    return made.select("metric", six("stored").alias("stored"), six("recomputed").alias("recomputed"))


def _doc(n: str, prefix: str = "document-") -> str:
    return f"'{prefix}' || lpad(CAST(({n}) % 100 AS VARCHAR), 4, '0')"


_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_BASE = f"""
pt AS (SELECT p_partkey AS pk, p_partkey % 100 AS doc, {_doc('p_partkey')} AS document, 'v' || (p_partkey // 100 % 2 + 1) AS version, p_name, p_name || ' of ' || p_brand AS phrase, p_type, p_brand FROM part),
docs AS (SELECT DISTINCT doc, document FROM pt),
ver AS (SELECT doc, document, version, CASE WHEN version = 'v2' AND doc % 17 = 0 THEN 'withdrawn' ELSE 'published' END AS status,
               CASE WHEN version = 'v1' THEN DATE '1995-01-01' + CAST(doc AS INTEGER) ELSE DATE '1998-01-01' + CAST(doc + CASE WHEN doc % 13 = 0 THEN 100 ELSE 0 END AS INTEGER) END AS f,
               CASE WHEN version = 'v1' THEN DATE '1998-01-01' + CAST(doc AS INTEGER) END AS t, list(DISTINCT phrase) AS phrases FROM pt GROUP BY ALL),
gr AS (SELECT 'a' || a AS actor, document, (doc + a) % 2 = 0 AS historical FROM docs, (SELECT unnest(range(5)) AS a) WHERE (doc + a) % 3 <> 0),
con AS (SELECT {_doc('doc', 'conflict-')} AS conflict, doc % 20 = 0 AS open, document AS l, {_doc('doc + 1')} AS r FROM docs WHERE doc % 10 = 0),
sides AS (SELECT conflict, open, l AS document, r AS other FROM con UNION ALL SELECT conflict, open, r, l FROM con),
cs AS (SELECT o_orderkey AS c, 'a' || (o_custkey % 5) AS actor, o_custkey AS cust, {_KINDS}[o_orderkey % 7 + 1] AS type, CASE WHEN o_orderkey % 7 IN (2, 6) THEN 'insufficient' ELSE 'evidence' END AS outcome,
              CASE WHEN o_orderkey % 7 = 3 THEN CAST(o_orderdate AS DATE) END AS day, o_orderpriority AS pr, o_totalprice AS price FROM orders),
ln AS (SELECT l_orderkey AS c, l_linenumber AS line, l_extendedprice AS ep, l_quantity AS q, l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls, l_discount AS disc, l_suppkey AS sk, pt.* FROM lineitem JOIN pt ON pk = l_partkey)
"""


def _observed(order: str, tag: str = "") -> str:
    """Observations of the run that ranks by `order`, as table ob."""
    return f"""
it{tag} AS (SELECT *, CAST(row_number() OVER (PARTITION BY c ORDER BY {order}, line, ep, pk, sk) AS INTEGER) AS rank, CASE WHEN line <> 7 THEN version END AS v FROM ln WHERE disc <= 0.06),
ex{tag} AS (SELECT c, line AS passage, document, version, p_name AS anchor, line % 3 + 1 AS grade FROM ln WHERE q > 25),
cr{tag} AS (SELECT i.c, passage, grade, min(rank) AS rank FROM it{tag} i JOIN ex{tag} e ON e.c = i.c AND e.document = i.document AND e.version = i.v AND contains(i.phrase, e.anchor) WHERE rank <= 8 GROUP BY ALL),
ga{tag} AS (SELECT i.c, i.rank, coalesce(max(grade), 0) AS gain FROM it{tag} i LEFT JOIN cr{tag} k ON k.c = i.c AND k.rank = i.rank WHERE i.rank <= 8 GROUP BY ALL),
ob{tag} AS (SELECT cs.c, type, outcome, (SELECT count(*) FROM it{tag} i WHERE i.c = cs.c) AS item_count, (SELECT count(*) FROM it{tag} i WHERE i.c = cs.c AND rank <= 8) AS items_within_k,
              (SELECT min(rank) FROM it{tag} i JOIN ex{tag} e ON e.c = i.c AND e.document = i.document AND e.version = i.v WHERE i.c = cs.c AND rank <= 8) AS source_rank,
              (SELECT min(rank) FROM cr{tag} k WHERE k.c = cs.c AND grade = 3) AS first_grade3_rank, (SELECT count(*) FROM cr{tag} k WHERE k.c = cs.c AND grade = 3) AS required_covered,
              (SELECT count(*) FROM ex{tag} e WHERE e.c = cs.c AND grade = 3) AS required_total,
              (SELECT count(*) FROM it{tag} i WHERE i.c = cs.c AND rank <= 8 AND type = 'distractor' AND document = {_doc('cust + 1')}) AS distractor_items,
              coalesce((SELECT list(gain ORDER BY rank) FROM ga{tag} g WHERE g.c = cs.c), []) AS gains, coalesce((SELECT list_slice(list_reverse_sort(list(grade)), 1, 8) FROM ex{tag} e WHERE e.c = cs.c), []) AS ideal FROM cs)
"""


_DCG = "coalesce(list_sum(list_transform({}, lambda g, i: (pow(2.0, g) - 1) / log2(i + 1.0))), 0.0)"
_LOW = f"CASE WHEN d = 0 THEN NULL WHEN n = 0 THEN 0.0 ELSE greatest(0.0, (n / d + {Z95**2} / (2 * d)) / (1 + {Z95**2} / d) - {Z95} / (1 + {Z95**2} / d) * sqrt(n / d * (1 - n / d) / d + {Z95**2} / (4 * d * d))) END"
_HIGH = f"CASE WHEN d = 0 THEN NULL WHEN n = d THEN 1.0 ELSE least(1.0, (n / d + {Z95**2} / (2 * d)) / (1 + {Z95**2} / d) + {Z95} / (1 + {Z95**2} / d) * sqrt(n / d * (1 - n / d) / d + {Z95**2} / (4 * d * d))) END"


def _measured(tag: str = "") -> str:
    """Metrics of table ob, as table me."""
    share = {
        "source_recall_at_k": ("outcome = 'evidence'", "source_rank IS NOT NULL"), "passage_recall_at_k": ("outcome = 'evidence'", "required_total > 0 AND required_covered = required_total"),
        "correct_abstention": ("outcome = 'insufficient'", "item_count = 0"), "false_abstention": ("outcome = 'evidence'", "item_count = 0"),
        "source_recall_at_1": ("outcome = 'evidence'", "source_rank <= 1"), "source_recall_at_3": ("outcome = 'evidence'", "source_rank <= 3"),
    }
    mean = {
        "mrr_at_k": "coalesce(1.0::DOUBLE / first_grade3_rank, 0)", "full_coverage_at_k": "CASE WHEN required_total = 0 THEN 0 ELSE required_covered / required_total END",
        "ndcg_at_k": f"CASE WHEN {_DCG.format('ideal')} = 0 THEN 0 ELSE {_DCG.format('gains')} / {_DCG.format('ideal')} END",
    }
    rows = [f"SELECT '{m}' AS metric, CAST(count(*) FILTER (WHERE {of} AND {hit}) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE {of}) AS DOUBLE) AS d, true AS share FROM ob{tag}" for m, (of, hit) in share.items()]
    rows += [f"SELECT '{m}', CAST(sum({x}) FILTER (WHERE outcome = 'evidence') AS DOUBLE), CAST(count(*) FILTER (WHERE outcome = 'evidence') AS DOUBLE), false FROM ob{tag}" for m, x in mean.items()]
    rows.append(f"SELECT 'distractor_intrusion', CAST(sum(distractor_items) FILTER (WHERE type = 'distractor') AS DOUBLE), CAST(sum(items_within_k) FILTER (WHERE type = 'distractor') AS DOUBLE), true FROM ob{tag}")
    return f"""
ra{tag} AS ({" UNION ALL ".join(rows)}),
me{tag} AS (SELECT metric, CASE WHEN share THEN n END AS numerator, d AS denominator, CASE WHEN d > 0 THEN n / d END AS value, CASE WHEN share THEN {_LOW} END AS low, CASE WHEN share THEN {_HIGH} END AS high FROM ra{tag})
"""


_RUN = f"{_BASE}, {_observed('ep DESC')}, {_measured()}"
_ROUND = "floor({0} * 1e6 + 0.5) / 1e6 AS {0}"
_GATES = f"""{_RUN}, {_observed('line', '2')}, {_measured('2')},
ru AS (SELECT * FROM (VALUES ('Q1', 'source_recall_at_k', true, 0.95::DOUBLE), ('Q2', 'passage_recall_at_k', true, 0.85), ('Q3', 'mrr_at_k', true, 0.7), ('Q4', 'correct_abstention', true, 0.8),
                             ('Q5', 'false_abstention', false, 0.1), ('Q6', 'distractor_intrusion', false, 0.1), ('Q7', 'reranker_uplift', true, NULL)) r(gate, metric, up, threshold)),
va AS (SELECT metric, value, low, high FROM me UNION ALL
       SELECT 'reranker_uplift', min(a.value - b.value), NULL, NULL FROM me a JOIN me2 b USING (metric) WHERE metric IN ('passage_recall_at_k', 'mrr_at_k')),
qg AS (SELECT gate, metric, value, threshold, CASE WHEN coalesce(CASE WHEN up THEN value >= coalesce(threshold, 0) - 1e-9 ELSE value <= threshold + 1e-9 END, false) THEN 'pass' ELSE 'fail' END AS status,
              value IS NOT NULL AND coalesce(CASE WHEN up THEN low < threshold ELSE high > threshold END, false) AS uncertain FROM ru LEFT JOIN va USING (metric))
"""
_VALID = "(SELECT min(version) FROM ver w WHERE w.document = {doc} AND w.status = 'published' AND w.f <= {day} AND (w.t IS NULL OR {day} < w.t))"
_TODAY = f"DATE '{TODAY}'"
_BREACHES = f"""
wh AS (SELECT i.*, cs.actor, cs.cust, cs.type, coalesce(cs.day, {_TODAY}) AS today, g.historical AS granted,
              CASE WHEN ls = 'F' THEN 'historical' ELSE 'current' END AS ts FROM it i JOIN cs USING (c) LEFT JOIN gr g ON g.actor = cs.actor AND g.document = i.document),
kn AS (SELECT wh.*, ver.status, ver.phrases, {_VALID.format(doc='wh.document', day='wh.today')} AS valid, {_VALID.format(doc='wh.document', day=_TODAY)} AS now,
              lag(wh.v) OVER (PARTITION BY c, wh.document ORDER BY rank) AS old FROM wh JOIN ver ON ver.document = wh.document AND ver.version = wh.v),
raws AS (SELECT c, actor, cust, string_agg(document, ' ') || CASE WHEN any_value(tell) THEN ' ' || any_value(extra) ELSE '' END AS raw FROM (
           SELECT cs.c, cs.actor, cs.cust, coalesce(i.document, '') AS document, cs.c % 10 = 0 AS tell,
                  {_doc('cs.cust')} || CASE WHEN cs.c % 20 = 0 THEN ' conflict-' || lpad(CAST(cs.cust // 10 % 10 * 10 AS VARCHAR), 4, '0') ELSE '' END AS extra FROM cs LEFT JOIN it i ON i.c = cs.c) GROUP BY ALL),
mk AS (SELECT document, document AS marker FROM docs UNION ALL SELECT document, conflict FROM sides),
hid AS (SELECT wh.*, s.other, EXISTS (SELECT 1 FROM gr g WHERE g.actor = wh.actor AND g.document = s.other) AS may, EXISTS (SELECT 1 FROM it o WHERE o.c = wh.c AND o.document = s.other) AS beside
        FROM wh JOIN sides s ON s.document = wh.document AND s.open WHERE {_VALID.format(doc='s.other', day='wh.today')} IS NOT NULL),
br AS (
  SELECT c, 'H1' AS gate, 'unknown' AS code, rank FROM wh WHERE v IS NULL UNION ALL
  SELECT c, 'H1', 'no_grant', rank FROM wh WHERE v IS NOT NULL AND granted IS NULL UNION ALL
  SELECT c, 'H1', 'no_historical_grant', rank FROM wh WHERE v IS NOT NULL AND ts = 'historical' AND NOT granted UNION ALL
  SELECT r.c, 'H2', 'marker', NULL FROM raws r JOIN mk ON contains(r.raw, mk.marker) WHERE NOT EXISTS (SELECT 1 FROM gr g WHERE g.actor = r.actor AND g.document = mk.document) UNION ALL
  SELECT c, 'H2', 'foreign_excerpt', rank FROM kn WHERE NOT list_contains(phrases, phrase) UNION ALL
  SELECT c, 'H2', 'mark_says_more', rank FROM it WHERE rf = 'N' AND tax > 0.07 UNION ALL
  SELECT c, 'H3', 'day', NULL FROM cs WHERE type = 'historical' AND c % 50 = 3 UNION ALL
  SELECT c, 'H3', 'withdrawn', rank FROM kn WHERE status <> 'published' UNION ALL
  SELECT c, 'H3', 'not_valid', rank FROM kn WHERE status = 'published' AND valid IS DISTINCT FROM v UNION ALL
  SELECT c, 'H3', 'wrong_status', rank FROM kn WHERE status = 'published' AND valid = v AND ts <> CASE WHEN now = v THEN 'current' ELSE 'historical' END UNION ALL
  SELECT c, 'H3', 'mixed', rank FROM kn WHERE old <> v UNION ALL
  SELECT c, 'H3', 'excluded', rank FROM kn WHERE c % 9 = 0 AND document = {_doc('cust')} UNION ALL
  SELECT c, 'H4', 'product', rank FROM it WHERE c % 11 = 0 AND p_type NOT IN ('ECONOMY', 'STANDARD') UNION ALL
  SELECT c, 'H4', 'type', rank FROM it WHERE c % 12 = 0 AND p_brand NOT IN ('Brand#1', 'Brand#2') UNION ALL
  SELECT c, 'H4', 'document', rank FROM wh WHERE c % 13 = 0 AND document <> {_doc('cust')} UNION ALL
  SELECT c, 'H5', 'unmarked', rank FROM hid WHERE may AND rf <> 'R' UNION ALL
  SELECT c, 'H5', 'one_sided', rank FROM hid WHERE may AND NOT beside UNION ALL
  SELECT c, 'H5', 'no_indicator', rank FROM hid WHERE NOT may AND rf <> 'N' UNION ALL
  SELECT c, 'H6', 'dev_override', NULL FROM cs WHERE pr = '5-LOW' UNION ALL
  SELECT c, 'H6', unnest(['no_reranker', 'reranker_grade', 'other_reranker']), NULL FROM cs WHERE pr = '4-NOT SPECIFIED' UNION ALL
  SELECT c, 'H6', unnest(['no_model', 'other_model']), NULL FROM cs WHERE price < 20000 UNION ALL
  SELECT DISTINCT c, 'H6', 'other_chunker', NULL FROM it WHERE q > 49)
"""
_RULES = """
mi AS (SELECT rule, least, count(type) AS n, count(type) >= least AS met FROM (VALUES ('answerable', ['direct', 'multi_chunk'], 20), ('unanswerable', ['unanswerable'], 5), ('historical', ['historical'], 3),
             ('conflict', ['conflict'], 2), ('distractor', ['distractor'], 3), ('access', ['permission', 'filter'], 3)) t(rule, types, least) LEFT JOIN cs ON list_contains(types, type) GROUP BY rule, least)
"""

QUERIES = {
    "case_breaches": (case_breaches, f'WITH {_BASE}, {_observed("ep DESC")}, {_BREACHES} SELECT c AS "case", gate, code, count(*) AS n, min(rank) AS first FROM br GROUP BY ALL'),
    "case_observations": (
        case_observations,
        f"""WITH {_BASE}, {_observed("ep DESC")} SELECT c AS "case", type, outcome, item_count, items_within_k, source_rank, first_grade3_rank, required_covered, required_total, distractor_items,
                   array_to_string(gains, ',') AS gains, array_to_string(ideal, ',') AS ideal FROM ob""",
    ),
    "run_metrics": (run_metrics, f"WITH {_RUN} SELECT metric, numerator, denominator, {_ROUND.format('value')}, {_ROUND.format('low')}, {_ROUND.format('high')} FROM me"),
    "quality_gate_results": (quality_gate_results, f"WITH {_GATES} SELECT gate, metric, {_ROUND.format('value')}, threshold, status, uncertain FROM qg"),
    "case_minimums": (case_minimums, f"WITH {_BASE}, {_RULES} SELECT rule, least, n, met FROM mi"),
    "run_verdict": (
        run_verdict,
        f"""WITH {_GATES}, {_BREACHES}, {_RULES},
                 bad AS (SELECT DISTINCT gate FROM br UNION SELECT gate FROM qg WHERE status <> 'pass' UNION SELECT rule FROM mi WHERE NOT met)
            SELECT CASE WHEN count(*) > 0 THEN 'fail' WHEN (SELECT bool_or(uncertain) FROM qg) THEN 'uncertain' ELSE 'pass' END AS verdict,
                   count(*) FILTER (WHERE gate IN ('H6', 'H7') OR gate IN (SELECT rule FROM mi)) = 0 AS valid, CASE WHEN (SELECT count(*) FROM cs) < 100 THEN 'pilot' ELSE 'standard' END AS tier,
                   CASE WHEN count(*) > 0 THEN 'fail' WHEN (SELECT bool_or(uncertain) FROM qg) THEN 'pass_with_uncertainty' ELSE 'pass' END AS outcome, coalesce(string_agg(gate, ',' ORDER BY gate), '') AS failed FROM bad""",
    ),
    "report_mismatches": (
        report_mismatches,
        f"""WITH {_RUN} SELECT metric, CASE WHEN metric = 'ndcg_at_k' THEN floor((value + 0.25) * 1e6 + 0.5) / 1e6 END AS stored, floor(value * 1e6 + 0.5) / 1e6 AS recomputed FROM me WHERE metric IN ('ndcg_at_k', 'mrr_at_k')
            UNION ALL SELECT 'unknown', 1.0, NULL""",
    ),
}
