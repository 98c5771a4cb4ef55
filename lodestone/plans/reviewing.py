"""Queries of reviews, quality facts and lists: orders stand for versions and answers, lines for citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import columns as x
from lodestone.operators import facts
from lodestone.operators import review as r
from lodestone.operators.contracts import CONTRACTS, KINDS, contract_breach
from lodestone.operators.many import composed, fused_many, rerank_none_many
from lodestone.plans.retrieval import _FUSED, _LEXICAL, _VECTOR, _lexical, _vector
from lodestone.sources.tables import table


def _review_tables(spark, sf):
    """Orders as versions of their customers' documents; a line is a page, and part of its version's report."""
    o, n = table(spark, sf, "orders"), F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    versions = o.select(
        n.alias("version"), (F.col("o_custkey") % 500).alias("document"), F.when(n % 3 == 0, "en").otherwise("da").alias("language"),
        F.when(F.col("o_orderstatus") == "F", F.when(n % 5 == 0, "published").otherwise("under_review")).when(F.col("o_orderstatus") == "O", "under_review").otherwise("discarded").alias("status"),
        F.when(n % 41 != 0, F.col("o_orderpriority")).alias("label"), F.when(n % 43 != 0, "title").otherwise(" ").alias("title"), F.when(n % 47 != 0, "terms").alias("document_type"),
        F.lit(1).alias("product"), F.when(n % 53 != 0, start).alias("valid_from"), F.when(n % 4 != 0, F.date_add(start, (n % 200 + 1).cast("int"))).alias("valid_to"), (n % 10 == 0).alias("superseded"),
        F.floor(F.col("o_totalprice") / 100).alias("checksum"),
    )
    lines = table(spark, sf, "lineitem")
    pages = lines.select(F.col("l_orderkey").alias("version"), (F.col("l_tax") < 0.08).alias("has_text"))
    reports = lines.groupBy(F.col("l_orderkey").alias("version"), F.col("l_returnflag").alias("finished_at")).agg(
        (F.max("l_discount") < 0.1).alias("all_read"), (F.max("l_quantity") > 20).alias("recognized"), F.count_if(F.col("l_quantity") < 5).alias("without_heading"),
        F.count_if(F.col("l_quantity") > 45).alias("uncertain_tables"), F.count_if(F.col("l_linenumber") == 7).alias("encoding_warnings"),
    )
    vectors = lines.groupBy(F.col("l_orderkey").alias("version")).agg(F.count("*").alias("chunks"), F.count_if(F.col("l_extendedprice") > 2000).alias("embedded"))
    grants = table(spark, sf, "customer").filter("c_acctbal > 2000").select((F.col("c_custkey") % 500).alias("document"))
    return versions, pages, reports, vectors, grants


def quality_facts(spark, sf):
    """AGG-23, with the plan of a publication."""
    versions, *_, grants = _review_tables(spark, sf)
    return facts.quality_facts(versions, grants).withColumn("missing", F.concat_ws(",", "missing"))


def review_state(spark, sf):
    """RET-11."""
    versions, pages, reports, vectors, grants = _review_tables(spark, sf)
    made = facts.review_states(versions, facts.quality_facts(versions, grants), pages, reports, vectors)
    return made.select("version", F.concat_ws(",", "blockers").alias("blockers"), F.concat_ws(",", "warnings").alias("warnings"))


_FACTS = """
v AS (SELECT o_orderkey AS version, o_custkey % 500 AS document, CASE WHEN o_orderkey % 3 = 0 THEN 'en' ELSE 'da' END AS language,
             CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'published' WHEN o_orderstatus IN ('F', 'O') THEN 'under_review' ELSE 'discarded' END AS status,
             CASE WHEN o_orderkey % 41 <> 0 THEN o_orderpriority END AS label, CASE WHEN o_orderkey % 43 <> 0 THEN 'title' ELSE ' ' END AS title, CASE WHEN o_orderkey % 47 <> 0 THEN 'terms' END AS kind,
             CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS f, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 + 1 AS INTEGER) END AS t,
             o_orderkey % 10 = 0 AS superseded, floor(o_totalprice / 100) AS checksum FROM orders),
pu AS (SELECT * FROM v WHERE status = 'published' AND f IS NOT NULL),
pre AS (SELECT v.version, arg_max(struct_pack(version := p.version, f := p.f, t := p.t, s := p.superseded), (p.f, p.version)) AS p FROM v JOIN pu p USING (document, language)
        WHERE v.status <> 'published' AND p.f <= v.f GROUP BY v.version),
fa AS (SELECT v.*, concat_ws(',', CASE WHEN label IS NULL THEN 'version_label' END, CASE WHEN f IS NULL THEN 'valid_from' END, CASE WHEN trim(title) = '' THEN 'title' END) AS missing,
              (SELECT count(*) FROM v o WHERE o.checksum = v.checksum AND o.version <> v.version AND o.status <> 'discarded') AS duplicates,
              (SELECT count(*) FROM pu o WHERE o.document = v.document AND o.language = v.language AND o.version <> v.version AND (v.t IS NULL OR o.f < v.t) AND (o.t IS NULL OR v.f < o.t)) AS ov,
              CASE WHEN NOT EXISTS (SELECT 1 FROM pu o WHERE o.document = v.document AND o.language = v.language AND o.version <> v.version AND o.f <= v.f - 1 AND (o.t IS NULL OR o.t > v.f - 1))
                   THEN (SELECT max(o.t) FROM pu o WHERE o.document = v.document AND o.language = v.language AND o.version <> v.version AND o.t < v.f) END AS gap_before,
              CASE WHEN v.t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pu o WHERE o.document = v.document AND o.language = v.language AND o.version <> v.version AND o.f <= v.t AND (o.t IS NULL OR o.t > v.t))
                   THEN (SELECT min(o.f) FROM pu o WHERE o.document = v.document AND o.language = v.language AND o.version <> v.version AND o.f > v.t) END AS gap_after,
              document NOT IN (SELECT c_custkey % 500 FROM customer WHERE c_acctbal > 2000) AS no_grants, CASE WHEN p.t IS NULL OR p.t > v.f THEN p END AS p FROM v LEFT JOIN pre ON pre.version = v.version),
pl AS (SELECT *, f IS NOT NULL AND NOT coalesce(p.f >= f OR p.s, false) AND ov - (p IS NOT NULL)::INT <= 0 AS good FROM fa),
fx AS (SELECT version, missing, duplicates, CASE WHEN f IS NULL THEN 0 ELSE ov END AS ov, CASE WHEN f IS NOT NULL THEN gap_before END AS gap_before, CASE WHEN f IS NOT NULL THEN gap_after END AS gap_after, no_grants,
              CASE WHEN status <> 'published' THEN good END AS ok, CASE WHEN status <> 'published' AND good THEN p.version END AS predecessor,
              coalesce(status <> 'published' AND good AND p IS NOT NULL AND t IS NOT NULL AND (p.t IS NULL OR p.t > t), false) AS plan_gap, status, label, title, kind, f FROM pl)
"""


def answer_checks(spark, sf):
    """EVL-5: orders are answers under one of six contracts, their lines the paragraphs, each with a citation or none."""
    lines = table(spark, sf, "lineitem")
    own = F.concat(F.lit("e"), F.col("l_partkey").cast("string"))
    sent = lines.filter("l_discount > 0.01").groupBy("l_orderkey", own.alias("id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("old"), F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05)).alias("hot"))
    sent = sent.groupBy("l_orderkey").agg(F.collect_list("id").alias("ids"), F.collect_list(F.when(F.col("old"), F.col("id"))).alias("old"), F.collect_list(F.when(F.col("hot"), F.col("id"))).alias("hot"))
    cite = F.when(F.col("l_quantity") > 10, own)
    part = lines.select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), "l_partkey", "l_quantity", cite.alias("cite")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    o = table(spark, sf, "orders").join(part, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").join(sent, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    x = F.coalesce("x", F.array().cast(o.schema["x"].dataType))

    def segments(p):
        said = F.struct(F.lit(None).cast("string").alias("cite"), F.lit("so it is").alias("text"))
        return F.when(p["cite"].isNull(), F.array(said)).otherwise(F.array(said, F.struct(p["cite"].alias("cite"), F.lit(None).cast("string").alias("text"))))

    n, who = F.col("o_orderkey"), F.col("o_custkey")
    paragraphs = F.transform(x, segments)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (who % 3 + 1).cast("int"))
    example = F.array(F.struct(F.lit("once").alias("text"), (who % 4 != 0).alias("fictional")))
    advice = F.transform(x, lambda p: F.struct(F.when(p["n"] == 7, "human").otherwise("ai_suggestion").alias("status"), segments(p).alias("segments")))
    criteria = F.transform(x, lambda p: F.struct(F.lit("c").alias("criterion"), F.when(p["n"] == 6, "maybe").otherwise("met").alias("verdict"), F.filter(F.array(p["cite"]), lambda c: c.isNotNull()).alias("cites")))
    answers = [
        F.struct(kind.alias("kind"), (who % 2 == 0).alias("historical"), paragraphs.alias("paragraphs")), F.struct(paragraphs.alias("paragraphs"), example.alias("examples")),
        F.struct(F.col("o_orderpriority").alias("reply"), F.when(who % 5 == 0, "e1").alias("cite")), F.struct(paragraphs.alias("points")), F.struct(advice.alias("suggestions")), F.struct(criteria.alias("criteria")),
    ]
    answer, contract = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, a) in enumerate(zip(CONTRACTS, answers, strict=True)):
        answer, contract = F.when(n % 6 == i, F.to_json(a)).otherwise(answer), F.when(n % 6 == i, name).otherwise(contract)
    made = o.select(n.alias("answer"), contract.alias("contract"), answer.alias("raw"), "ids", "old", "hot")
    return made.select("answer", "contract", contract_breach("contract", "raw", "ids", "old", "hot").alias("code"))


def call_records(spark, sf):
    """EVL-7."""
    lines = table(spark, sf, "lineitem").filter("l_discount > 0.08").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("s"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    calls = o.select(F.col("o_orderkey").alias("call"), F.coalesce("s", F.array().cast("array<bigint>")).alias("sources"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("case"))
    return r.recorded_calls(calls)


def search_availability(spark, sf):
    """EVL-4: parts as services, their numbers as what is known of each."""
    n = F.col("p_partkey")
    unmet = F.filter(F.array(*[F.when(n % k == 0, f"P{i}") for i, k in enumerate((5, 7, 3, 4, 2, 9, 2, 2, 11), 1)]), lambda x: x.isNotNull())
    status = F.when(n % 6 == 0, None).when(n % 13 == 0, "suspended").otherwise("active")
    problem = F.when(n % 31 == 0, "no_credentials")
    outcome = F.when(n % 2 == 0, "pass").otherwise("pass_with_uncertainty")
    made = r.availability(n % 17 == 0, n % 19 != 0, n % 23 != 0, n % 29 != 0, problem, status, unmet, outcome, n % 3 == 0)
    return table(spark, sf, "part").select(n, made.alias("a")).select("p_partkey", "a.state", "a.grade", "a.reason")


def pages_without_headers(spark, sf):
    """DOC-1."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id", F.regexp_replace("html", ">", ">\n").alias("text"))
    made = r.without_headers(p, "host", "page_id")
    return made.select("page_id", "removed", F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


def line_blocks(spark, sf):
    """DOC-2."""
    made = r.line_blocks(table(spark, sf, "documents").filter("text is not null"), "doc_id")
    return made.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum("lines").alias("lines"), F.min("block").alias("first"))


def quality_report(spark, sf):
    """Documents with text and in all, and lines by kind, of each source (AGG-22)."""
    d = table(spark, sf, "documents")
    lines = d.select("source", F.explode(F.split("text", "\n")).alias("line"))
    kinds = lines.groupBy("source").agg(F.count_if(x.listed("line")).alias("listed"), F.count_if(F.trim("line") == "").alias("empty"), F.count("*").alias("lines"))
    read = d.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.length(F.trim("text")) > 0).alias("read"))
    return read.join(kinds, "source", "left")


def database_quality(spark, sf):
    """Copies, short texts and missing labels of each source (AGG-23)."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"), F.length("text").alias("n"))
    copies = d.groupBy("hash").agg(F.count("*").alias("times"))
    labels = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("labelled"))
    made = d.join(copies, "hash", "left").join(labels, "doc_id", "left").groupBy("source")
    return made.agg(F.count_if(F.col("times") > 1).alias("copies"), F.count_if(F.col("n") < 50).alias("short"), F.count_if(F.col("labelled").isNull()).alias("unlabelled"))


def leaders(spark, sf):
    """Suppliers over each customer, by name, and the scopes through which (AGG-29, APP-6)."""
    s = table(spark, sf, "supplier").filter("s_acctbal > 3000").select("s_nationkey", "s_name", F.when(F.col("s_acctbal") > 7000, "all").otherwise("team").alias("scope"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    over = s.groupBy("s_nationkey").agg(*[F.array_join(F.array_sort(F.collect_set(x)), ",").alias(n) for x, n in (("s_name", "leaders"), ("scope", "scopes"))])
    # A nation's list is joined to a text once; customers, each of whom gets it, are dealt to all tasks, and the few lists go to them.
    made = c.repartition("c_custkey").join(F.broadcast(over), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return made.select("c_custkey", "n_name", *[F.coalesce(x, F.lit("")).alias(x) for x in ("leaders", "scopes")])


def role_matrix(spark, sf):
    """How many customers of each nation are in which segment, a column each (APP-6)."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    counts = [F.count_if(F.col("c_mktsegment") == s).alias(s.lower()) for s in segments]
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(*counts)


def version_list(spark, sf):
    """Orders as versions: whether a gap of over 90 days follows, the latest returned line, and the status (APP-1)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("next", F.lead("o_orderdate").over(w))
    failed = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("failure"))
    made = o.join(failed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return made.select("o_orderkey", F.coalesce(F.datediff("next", "o_orderdate") > 90, F.lit(False)).alias("gap"), "failure", "o_orderstatus")


def conflict_list(spark, sf):
    """Parts with lines of both statuses, and the orders on either side (APP-3)."""
    lines = table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey", "l_linestatus", "l_orderkey")
    made = lines.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")))).alias("o"),
        F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey")))).alias("f"),
    )
    made = made.filter((F.size("o") > 0) & (F.size("f") > 0)).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return made.select("p_partkey", "p_name", F.array_join(F.col("o").cast("array<string>"), ",").alias("open"), F.array_join(F.col("f").cast("array<string>"), ",").alias("closed"))


def embedding_settings(spark, sf):
    """Embeddings of each label as a model, and how many documents are published (APP-4, AGG-24)."""
    published = table(spark, sf, "documents").filter("doc_id % 7 <> 0").agg(F.count("*").alias("published"))
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("embeddings"), F.count_if(F.size("embedding") != 64).alias("wrong"))
    return e.crossJoin(F.broadcast(published))


def operations_view(spark, sf):
    """Each priority's five newest orders, unapproved ones first (APP-5, AGG-19)."""
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    o = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(*order))).filter("n <= 5")
    shown = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy((F.col("o_orderstatus") == "F"), *order))
    return o.select("o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "F").alias("approved"), shown.alias("place"))


def visible_categories(spark, sf):
    """Categories of parts that a leader sees: of small ones all, of others those over a price (APP-8)."""
    p = table(spark, sf, "part").filter("p_size < 10 or p_retailprice > 1200")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"))


def natural_order(spark, sf):
    """Customers' places by segment, then by the number in their names, falling (SRT-7)."""
    number = F.regexp_extract("c_name", "([0-9]+)", 1).cast("bigint")
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last("c_mktsegment"), number.desc_nulls_first())
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(w).alias("place"))


def timed_steps(spark, sf):
    """Milliseconds from each event of a user to the next, by type (STM-9)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_millis(F.col("ts").cast("timestamp"))
    made = table(spark, sf, "events").select("event_type", ms.alias("ms"))
    return made.groupBy("event_type").agg(F.count("ms").alias("steps"), F.count_if(F.col("ms") > 3_600_000).alias("slow"))


def stemmed_terms(spark, sf):
    """Distinct stems of each document (RET-1, UDF-2)."""
    t = table(spark, sf, "documents").select("doc_id", F.explode(x.tokens("text")).alias("token"))
    made = t.select("doc_id", r.stemmed("token", ("er", "en", "ing", "erne")).alias("stem")).distinct()
    return made.groupBy("doc_id").agg(F.count("*").alias("stems"), F.sum(F.length("stem")).alias("letters"))


def conflict_candidates(spark, sf):
    """Documents of different sources with one content, each source's first against the first of all, by a canonical
    fingerprint (RET-7, JOIN-8)."""
    d = table(spark, sf, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("hash"), "source").agg(F.min("doc_id").alias("version"))
    first = d.groupBy("hash").agg(F.min("version").alias("least"))
    made = d.join(first, "hash").filter("version <> least")
    return made.select("source", F.concat_ws(":", F.lit("duplicate_content"), F.least("version", "least"), F.greatest("version", "least")).alias("fingerprint"))


def health_json(spark, sf):
    """One nested object of the service's health (AGG-2, AGG-25, JSN-2)."""
    e = table(spark, sf, "events")
    by_type = e.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("by_type"))
    one = e.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    o = table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))
    made = one.crossJoin(by_type).crossJoin(o)  # one row each
    return made.select(F.to_json(F.struct("events", "errors", "users", "by_type", F.struct("pending", "newest").alias("queue"))).alias("health"))


def composed_search(spark, sf):
    """RET-3: fusion, rerank, caps and merge in one, for each question."""
    both = rerank_none_many(fused_many(_vector(spark, sf), _lexical(spark, sf).drop("lexical_terms")), 30)
    own = both.select("query_id", "chunk_id", "score", "fused_rank", F.floor(F.col("chunk_id") / 20).alias("version"), (F.col("chunk_id") % 20).alias("chunk_index"))
    made = composed(own, "version", "chunk_index", 3, 20, 0.1)
    return made.groupBy("query_id", "version", "island").agg(F.count("*").alias("chunks"), F.max("score").alias("score"), F.min("rank").alias("rank"))


_KIND = r"""CASE WHEN l = '' THEN 'empty' WHEN regexp_matches(l, '^§\s*\d+') OR regexp_matches(l, '^\d+(?:\.\d+)*\.?\s+\p{L}') THEN 'heading' WHEN regexp_matches(l, '^\s*(?:[-•–*]|\d+[.)]|[a-zæøå][.)])\s+') THEN 'list'
     WHEN len(regexp_extract_all(l, '\S {2,}\S')) > 1 THEN 'table' WHEN length(l) < 60 AND NOT regexp_matches(l, '[.!?:;,]$') THEN 'heading' ELSE 'text' END"""
_BOTH = f"""WITH {_VECTOR}, {_LEXICAL}, {_FUSED},
s AS (SELECT query_id, chunk_id, floor(fused_score / max(fused_score) OVER (PARTITION BY query_id) * 1e6 + 0.5) / 1e6 AS score, fused_rank AS fr FROM g),
c AS (SELECT *, chunk_id // 20 AS version, chunk_id % 20 AS i FROM s WHERE fr <= 30 AND score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id // 20 ORDER BY score DESC, fr) <= 3),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr) AS rank FROM c QUALIFY rank <= 20),
h AS (SELECT *, i - row_number() OVER (PARTITION BY query_id, version ORDER BY i) AS run FROM d)
"""
_HEADERS = r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id, list_filter(list_transform(string_split(replace(html, '>', '>' || chr(10)), chr(10)), lambda y: trim(regexp_replace(y, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda y: y <> '') AS lines FROM pages),
u AS (SELECT host, page_id, len(lines) AS n, unnest(lines) AS line, unnest(range(0, len(lines))) AS place FROM p),
e AS (SELECT *, CASE WHEN place < 2 OR place >= n - 2 THEN regexp_replace(lower(line), '[0-9]+', '#', 'g') END AS key FROM u),
c AS (SELECT host, key, count(DISTINCT page_id) AS k FROM e WHERE key IS NOT NULL GROUP BY ALL), m AS (SELECT host, count(*) AS m FROM p WHERE len(lines) > 0 GROUP BY host),
b AS (SELECT host, key FROM c JOIN m USING (host) WHERE k >= greatest(3, ceil(m / 2)))
"""
QUERIES = {
    "quality_facts": (quality_facts, f"WITH {_FACTS} SELECT version, missing, duplicates, ov AS \"overlaps\", gap_before, gap_after, no_grants, ok, predecessor, plan_gap FROM fx"),
    "review_state": (
        review_state,
        f"""WITH {_FACTS},
                 pg AS (SELECT l_orderkey AS version, count(*) FILTER (WHERE l_tax >= 0.08) AS unread, count(*) AS chunks, count(*) FILTER (WHERE l_extendedprice > 2000) AS embedded FROM lineitem GROUP BY 1),
                 rp AS (SELECT l_orderkey AS version, l_returnflag AS at_, max(l_discount) < 0.1 AS all_read, max(l_quantity) > 20 AS known, count(*) FILTER (WHERE l_quantity < 5) AS bare,
                               count(*) FILTER (WHERE l_quantity > 45) AS doubt, count(*) FILTER (WHERE l_linenumber = 7) AS enc FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC) = 1)
            SELECT version, concat_ws(',', CASE WHEN status <> 'under_review' THEN 'not_under_review' END, CASE WHEN label IS NULL OR f IS NULL OR trim(title) = '' OR kind IS NULL THEN 'metadata_missing' END,
                     CASE WHEN coalesce(unread > 0, true) OR NOT coalesce(all_read, false) THEN 'pages_unread' END, CASE WHEN NOT coalesce(chunks > 0 AND embedded >= chunks, false) THEN 'embeddings_missing' END,
                     CASE WHEN f IS NOT NULL AND NOT coalesce(ok, false) THEN 'validity_conflict' END) AS blockers,
                   concat_ws(',', CASE WHEN no_grants THEN 'no_grants' END, CASE WHEN duplicates > 0 THEN 'duplicate' END, CASE WHEN predecessor IS NOT NULL THEN 'predecessor_superseded' END,
                     CASE WHEN plan_gap OR gap_before IS NOT NULL THEN 'validity_gap' END, CASE WHEN NOT coalesce(known, true) THEN 'structure_not_recognized' END, CASE WHEN bare > 0 THEN 'chunks_without_heading' END,
                     CASE WHEN doubt > 0 THEN 'uncertain_tables' END, CASE WHEN enc > 0 THEN 'encoding' END) AS warnings
            FROM fx LEFT JOIN pg USING (version) LEFT JOIN rp USING (version)""",
    ),
    "answer_checks": (
        answer_checks,
        f"""WITH s AS (SELECT l_orderkey AS a, l_partkey AS p, bool_or(l_returnflag = 'R') AS old, bool_or(l_linestatus = 'F' AND l_tax > 0.05) AS hot FROM lineitem WHERE l_discount > 0.01 GROUP BY 1, 2),
                 l AS (SELECT l_orderkey AS a, l_linenumber AS n, l_partkey AS part, l_quantity AS q, CASE WHEN l_quantity > 10 THEN l_partkey END AS p FROM lineitem),
                 j AS (SELECT l.*, l.p IS NOT NULL AND s.a IS NULL AS bad, coalesce(old, false) AS old, coalesce(hot, false) AS hot FROM l LEFT JOIN s ON s.a = l.a AND s.p = l.p),
                 k AS (SELECT *, CASE WHEN n = 7 THEN 'malformed' WHEN bad THEN 'unknown_citation' WHEN p IS NULL THEN 'uncited_paragraph' END AS advise,
                                 CASE WHEN n = 6 THEN 'malformed' WHEN bad THEN 'unknown_citation' WHEN p IS NULL THEN 'uncited_paragraph' END AS assess FROM j),
                 g AS (SELECT a, count(*) AS m, bool_or(bad) AS bad, bool_or(p IS NULL) AS open, bool_or(old) AS old, bool_or(hot) AS hot,
                              arg_min(advise, (n, part, q)) FILTER (WHERE advise IS NOT NULL) AS advise, arg_min(assess, (n, part, q)) FILTER (WHERE assess IS NOT NULL) AS assess FROM k GROUP BY a),
                 o AS (SELECT o_orderkey AS answer, o_custkey AS w, {KINDS}[o_custkey % 3 + 1] AS kind, g.* FROM orders LEFT JOIN g ON a = o_orderkey)
            SELECT answer, {CONTRACTS}[answer % 6 + 1] AS contract, CASE
                WHEN answer % 6 = 2 THEN CASE WHEN w % 5 = 0 THEN 'unexpected_citation' END
                WHEN m > 20 THEN 'too_long'
                WHEN answer % 6 = 4 THEN coalesce(advise, CASE WHEN m IS NULL THEN 'malformed' END)
                WHEN answer % 6 = 5 THEN assess
                WHEN bad THEN 'unknown_citation'
                WHEN answer % 6 = 0 AND kind = 'insufficient' THEN NULL
                WHEN m IS NULL THEN 'malformed'
                WHEN answer % 6 = 3 THEN NULL
                WHEN open THEN 'uncited_paragraph'
                WHEN answer % 6 = 1 THEN CASE WHEN w % 4 = 0 THEN 'example_not_marked' END
                WHEN old AND w % 2 <> 0 THEN 'missing_historical_marker'
                WHEN hot AND kind <> 'conflict' THEN 'conflict_not_flagged' END AS code FROM o""",
    ),
    "call_records": (
        call_records,
        """WITH l AS (SELECT l_orderkey AS call, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS INTEGER) AS ordinal, l_partkey AS source FROM lineitem WHERE l_discount > 0.08)
           SELECT o_orderkey AS call, ordinal, source, CASE WHEN source IS NULL AND o_custkey % 2 <> 0 THEN o_orderpriority END AS question FROM orders LEFT JOIN l ON call = o_orderkey""",
    ),
    "search_availability": (
        search_availability,
        """WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 17 = 0 THEN 'demo' WHEN p_partkey % 19 = 0 THEN 'no_database' WHEN p_partkey % 23 = 0 THEN 'model_unreadable'
                             WHEN p_partkey % 29 = 0 THEN 'context_unreadable' WHEN p_partkey % 31 = 0 THEN 'no_credentials' END AS bad,
                             concat_ws(', ', CASE WHEN p_partkey % 5 = 0 THEN 'P1' END, CASE WHEN p_partkey % 7 = 0 THEN 'P2' END, CASE WHEN p_partkey % 3 = 0 THEN 'P3' END, CASE WHEN p_partkey % 4 = 0 THEN 'P4' END,
                                       CASE WHEN p_partkey % 9 = 0 THEN 'P6' END, CASE WHEN p_partkey % 11 = 0 THEN 'P9' END) AS unmet FROM part),
                q AS (SELECT *, CASE WHEN unmet = '' THEN NULL WHEN n % 6 = 0 THEN 'no_configuration' WHEN n % 13 = 0 THEN 'suspended' WHEN n % 4 = 0 THEN 'other_fingerprint'
                                     WHEN n % 2 <> 0 AND n % 3 <> 0 THEN 'uncertainty_not_accepted' ELSE 'unmet: ' || unmet END AS why FROM p)
           SELECT n AS p_partkey, CASE WHEN bad IS NULL THEN 'available' ELSE 'unavailable' END AS state, CASE WHEN bad IS NULL THEN CASE WHEN why IS NULL THEN 'production' ELSE 'development' END END AS grade, coalesce(bad, why) AS reason FROM q""",
    ),
    "pages_without_headers": (
        pages_without_headers,
        f"{_HEADERS} SELECT page_id, count(*) FILTER (WHERE b.key IS NOT NULL) AS removed, greatest(1, count(*) FILTER (WHERE b.key IS NULL)) AS lines FROM e LEFT JOIN b ON e.host = b.host AND e.key = b.key GROUP BY e.host, page_id",
    ),
    "line_blocks": (
        line_blocks,
        f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, trim(unnest(s)) AS l, unnest(range(0, len(s))) AS place FROM s),
                 k AS (SELECT doc_id, place, {_KIND} AS kind FROM u),
                 n AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY place) THEN 1 ELSE 0 END AS new FROM k),
                 g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM n),
                 b AS (SELECT doc_id, run, kind, min(place) AS first, count(*) AS lines FROM g WHERE kind <> 'empty' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS block FROM b)
            SELECT doc_id, kind, count(*) AS blocks, CAST(sum(lines) AS BIGINT) AS lines, CAST(min(block) AS INTEGER) AS first FROM r GROUP BY doc_id, kind""",
    ),
    "quality_report": (
        quality_report,
        r"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
                 k AS (SELECT source, count(*) FILTER (WHERE regexp_matches(line, '^\s*(?:[-•–*]|\d+[.)]|[a-zæøå][.)])\s+')) AS listed, count(*) FILTER (WHERE trim(line) = '') AS empty, count(*) AS lines FROM l GROUP BY source)
            SELECT source, count(*) AS documents, count(*) FILTER (WHERE length(trim(text)) > 0) AS read, any_value(listed) AS listed, any_value(empty) AS empty, any_value(lines) AS lines FROM documents LEFT JOIN k USING (source) GROUP BY source""",
    ),
    "database_quality": (
        database_quality,
        """WITH d AS (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS times FROM documents WHERE text IS NOT NULL)
           SELECT source, count(*) FILTER (WHERE times > 1) AS copies, count(*) FILTER (WHERE length(text) < 50) AS short, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM d GROUP BY source""",
    ),
    "leaders": (
        leaders,
        """WITH o AS (SELECT s_nationkey, array_to_string(list_sort(list_distinct(list(s_name))), ',') AS leaders, array_to_string(list_sort(list_distinct(list(CASE WHEN s_acctbal > 7000 THEN 'all' ELSE 'team' END))), ',') AS scopes
                      FROM supplier WHERE s_acctbal > 3000 GROUP BY 1)
           SELECT c_custkey, n_name, coalesce(leaders, '') AS leaders, coalesce(scopes, '') AS scopes FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON s_nationkey = c_nationkey""",
    ),
    "role_matrix": (
        role_matrix,
        "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY c_nationkey",
    ),
    "version_list": (
        version_list,
        """WITH o AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders), f AS (SELECT l_orderkey, max(l_linenumber) AS failure FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
           SELECT o_orderkey, coalesce(date_diff('day', CAST(o_orderdate AS DATE), CAST(next AS DATE)) > 90, false) AS gap, failure, o_orderstatus FROM o LEFT JOIN f ON l_orderkey = o_orderkey""",
    ),
    "conflict_list": (
        conflict_list,
        """WITH g AS (SELECT l_partkey, list_sort(list_distinct(list(l_orderkey) FILTER (WHERE l_linestatus = 'O'))) AS o, list_sort(list_distinct(list(l_orderkey) FILTER (WHERE l_linestatus = 'F'))) AS f FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
           SELECT p_partkey, p_name, array_to_string(o, ',') AS open, array_to_string(f, ',') AS closed FROM g JOIN part ON p_partkey = l_partkey WHERE len(o) > 0 AND len(f) > 0""",
    ),
    "embedding_settings": (
        embedding_settings,
        "SELECT label, count(*) AS embeddings, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS published FROM embeddings GROUP BY label",
    ),
    "operations_view": (
        operations_view,
        """WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5)
           SELECT o_orderpriority, o_orderkey, o_orderstatus = 'F' AS approved, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM o""",
    ),
    "visible_categories": (visible_categories, "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 10 OR p_retailprice > 1200 GROUP BY 1"),
    "natural_order": (
        natural_order,
        "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS LAST, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) DESC NULLS FIRST) AS INTEGER) AS place FROM customer",
    ),
    "timed_steps": (
        timed_steps,
        """WITH s AS (SELECT event_type, epoch_ms(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_ms(ts) AS ms FROM events)
           SELECT event_type, count(ms) AS steps, count(*) FILTER (WHERE ms > 3600000) AS slow FROM s GROUP BY event_type""",
    ),
    "stemmed_terms": (
        stemmed_terms,
        r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}§]+')) AS w FROM documents),
                 s AS (SELECT DISTINCT doc_id, CASE WHEN w LIKE '%erne' AND length(w) >= 7 THEN left(w, length(w) - 4) WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3)
                              WHEN (w LIKE '%er' OR w LIKE '%en') AND length(w) >= 5 THEN left(w, length(w) - 2) ELSE w END AS stem FROM t)
            SELECT doc_id, count(*) AS stems, CAST(sum(length(stem)) AS BIGINT) AS letters FROM s GROUP BY doc_id""",
    ),
    "conflict_candidates": (
        conflict_candidates,
        """WITH d AS (SELECT sha256(text) AS h, source, min(doc_id) AS v FROM documents WHERE text IS NOT NULL GROUP BY ALL), f AS (SELECT *, min(v) OVER (PARTITION BY h) AS m FROM d)
           SELECT source, 'duplicate_content:' || least(v, m) || ':' || greatest(v, m) AS fingerprint FROM f WHERE v <> m""",
    ),
    "health_json": (
        health_json,
        """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
           SELECT '{"events":' || (SELECT count(*) FROM events) || ',"errors":' || (SELECT count(*) FROM events WHERE event_type = 'error') || ',"users":' || (SELECT count(DISTINCT user_id) FROM events)
                  || ',"by_type":{' || (SELECT string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) FROM t) || '},"queue":{"pending":' || (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')
                  || ',"newest":"' || (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) || '"}}' AS health""",
    ),
    "composed_search": (composed_search, f"{_BOTH} SELECT query_id, version, min(i) AS island, count(*) AS chunks, max(score) AS score, CAST(min(rank) AS INTEGER) AS rank FROM h GROUP BY query_id, version, run"),
}
