"""Stems, cover density and searches of a stored index, against plain Python."""

import random
from collections import defaultdict

import pytest
from lodestone.functions.danish import STOP_WORDS, danish_stem, stem_of
from lodestone.operators.index import build, by_cover, by_shared_words, counted, covers, stored
from lodestone.operators.many import composed, fused_many, vector_many
from pyspark.sql import functions as F

#: Pairs of the sample vocabulary that is published with the algorithm.
STEMS = (
    "indtage indtag indtagelse indtag indtaget indtag indtryk indtryk indtræder indtræd indtræffer indtræf indtrængende indtræng indtægt indtæg indvandrede indvandred "
    "indvende indv indvendigt indvend indvendingerne indvending indviede indvied indvielsen indvi indvielsesløfte indvielsesløft indviet indvi indvikler indvikl "
    "indvoldene indvold indvortes indvort indånde indånd indåndede indånded undersåtter undersåt arbejdsløst arbejdsløs heldigst held en en to to 12 12 § §"
).split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    df = spark.createDataFrame(pairs, "word string, want string").withColumn("got", danish_stem("word"))
    assert [(r.word, r.got) for r in df.collect()] == pairs


def test_both_stemmers_agree(spark):
    random.seed(4)
    ends = ["", "erne", "hedens", "s", "igst", "løst", "elig", "gd", "kt", "ll"]
    words = sorted({"".join(random.choices("aeiyæøåbdgklnst", k=random.randint(1, 6))) + random.choice(ends) + random.choice(ends) for _ in range(3000)})
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", danish_stem("word").alias("stem"))
    assert [(r.word, r.stem) for r in df.collect() if r.stem != stem_of(r.word)] == []


def test_counts_of_words_need_no_postings(spark, library):
    rows, _, docs, _ = library
    want = {}
    for _, text in rows:
        words = (text or "").split()
        for kind, all_words in (("simple", words), ("danish", [None if w in STOP_WORDS else stem_of(w) for w in words])):
            for w in set(all_words) - {None}:
                n, places, last = want.get((kind, w), (0, 0, 0))
                at = [i + 1 for i, x in enumerate(all_words) if x == w]
                want[kind, w] = n + 1, places + len(at), max(last, at[-1])
    assert {(r.kind, r.token): (r.documents, r.places, r.last) for r in counted(docs, "id").collect()} == want


def test_an_index_for_some_questions_holds_their_words_alone(spark, library):
    _, _, docs, questions = library
    few = questions.filter("query_id in (1, 92)")
    whole, own = build(docs, "id"), build(docs, "id", asks=few)
    asked = {w for r in few.collect() for w in r.text.split()}
    assert {r.token for r in own.postings.select("token").distinct().collect()} == asked
    for search in (by_shared_words, by_cover):
        assert sorted(map(repr, search(own, few).collect())) == sorted(map(repr, search(whole, few).collect())) != []


def plain_covers(places, terms):
    """Every stretch with all words of which no shorter part has all."""
    at = sorted({p for p, _ in places})
    full = [(l, r) for l in at for r in at if l <= r and {t for p, t in places if l <= p <= r} == set(range(1, terms + 1))]
    least = [(l, r) for l, r in full if not any((a, b) != (l, r) and l <= a and b <= r for a, b in full)]
    return sum(0.1 / (1 + (r - l) - (sum(l <= p <= r for p in at) - 1)) for l, r in least)


def test_covers(spark):
    random.seed(3)
    cases = [sorted((p, random.randint(1, n)) for p in random.sample(range(1, 30), random.randint(1, 12))) for n in (1, 2, 3, 4) for _ in range(25)]
    terms = [n for n in (1, 2, 3, 4) for _ in range(25)]
    df = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(zip(cases, terms, strict=True))], "i int, at array<struct<at:int,term:int>>, n int")
    got = {r.i: (r.c, r.any) for r in df.select("i", covers(F.col("at"), F.col("n")).alias("c"), covers(F.col("at")).alias("any")).collect()}
    for i, x in enumerate(cases):
        assert got[i][0] == pytest.approx(plain_covers(x, terms[i])) and got[i][1] == pytest.approx(0.1 * len(x))


@pytest.fixture(scope="module")
def library(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(random.choices(words, weights, k=random.randint(0, 60)))) for i in range(400)] + [(1000, None), (1001, "")]
    asks = [(i, " ".join(random.sample(words, n))) for i, n in enumerate((1, 2, 5, 9, 20, 40))] + [(90, None), (91, "nowhere words"), (92, "w0 w0 w1")]
    return rows, asks, spark.createDataFrame(rows, "id long, text string").repartition(4), spark.createDataFrame(asks, "query_id long, text string")


@pytest.mark.parametrize("k", [3, 50])
def test_early_stop_loses_nothing(spark, library, k):
    rows, asks, docs, questions = library
    got = defaultdict(list)
    for r in by_shared_words(build(docs, "id"), questions, k).orderBy("query_id", "lexical_rank").collect():
        got[r.query_id].append((r.key, r.lexical_score, tuple(r.lexical_terms)))
    for q, text in asks:
        terms = set((text or "").split())
        scored = [(i, len(terms & set((t or "").split())) / max(1, len(terms)), tuple(sorted(terms & set((t or "").split())))) for i, t in rows]
        want = sorted((x for x in scored if x[1]), key=lambda x: (-x[1], x[0]))[:k]
        assert [(i, terms) for i, _, terms in got[q]] == [(i, terms) for i, _, terms in want]


def test_a_filter_comes_before_ranks(spark, library):
    _, _, docs, questions = library
    even = docs.filter("id % 2 = 0")
    index = build(docs, "id")
    within = by_shared_words(index, questions, 5, even.select(F.col("id").alias("key"))).drop("lexical_terms")
    alone = by_shared_words(build(even, "id"), questions, 5).drop("lexical_terms")
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, alone.collect())) != []


def test_rarest_words_are_all_outside_of_a_filter(spark):
    docs = spark.createDataFrame([(i, "rare common") for i in range(5)] + [(10 + i, "common") for i in range(3)], "id long, text string")
    asks = spark.createDataFrame([(0, "rare common")], "query_id long, text string")
    own = docs.filter("id >= 10").select(F.col("id").alias("key"))
    got = by_shared_words(build(docs, "id"), asks, 4, own).orderBy("lexical_rank").collect()
    assert [(r.key, r.lexical_score, r.lexical_terms) for r in got] == [(10, 0.5, ["common"]), (11, 0.5, ["common"]), (12, 0.5, ["common"])]


def test_an_index_is_written_once(spark, library):
    _, _, docs, questions = library
    build(docs, "id", name="once", buckets=3)
    again = stored(spark, "once")
    first = by_cover(again, questions, 10)
    assert first.count() and by_shared_words(again, questions, 10).count()
    plan = again.postings.filter("kind = 'simple'").join(spark.table("once_postings").filter("kind = 'simple'").select("token", "part").distinct(), ["token", "part"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "SelectedBucketsCount" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stop_words_and_stems_meet(spark):
    docs = spark.createDataFrame([(1, "Husene er store"), (2, "et hus"), (3, "og den er"), (4, "skib")], "id long, text string")
    asks = spark.createDataFrame([(0, "huset og den store")], "query_id long, text string")
    got = {r.key: r.lexical_score for r in by_cover(build(docs, "id"), asks).collect()}
    assert got == {1: pytest.approx(0.3), 2: pytest.approx(0.1), 3: pytest.approx(0.2)}  # both kinds; stems; plain words alone


def test_vectors(spark):
    random.seed(9)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(500 + i, [1.0] + [0.0] * 5) for i in range(40)]
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [1.0, 2.0]), (905, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").repartition(5)
    asks = df.filter("chunk_id % 50 = 0 or chunk_id >= 900").withColumnRenamed("chunk_id", "query_id")
    got = defaultdict(list)
    for r in vector_many(df, asks, 7, rows=64, query_rows=3).orderBy("query_id", "vector_rank").collect():
        got[r.query_id].append((r.chunk_id, r.vector_score))

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    good = [x for x in rows + odd if x[0] is not None and x[1] and all(y is not None and y == y for y in x[1])]
    for q, v in good:
        if q % 50 == 0 or q >= 900:
            want = sorted(((i, round(cosine(v, u), 6)) for i, u in good if len(u) == len(v)), key=lambda x: (-x[1], x[0]))[:7]
            assert [i for i, _ in got[q]] == [i for i, _ in want]
    assert set(got) == {q for q, _ in good if q % 50 == 0 or q >= 900}


def test_fusion_by_question(spark):
    near = spark.createDataFrame([(q, i, 1 - i / 10, i + 1) for q in (1, 2) for i in range(4)], "query_id long, chunk_id long, vector_score double, vector_rank int")
    lexical = spark.createDataFrame([(1, 3, 0.5, 1), (1, 9, 0.4, 2), (3, 5, 1.0, 1)], "query_id long, chunk_id long, lexical_score double, lexical_rank int")
    rows = fused_many(near, lexical).orderBy("query_id", "fused_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [(1, 3), (1, 0), (1, 1), (1, 9), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (3, 5)]
    own = fused_many(near, lexical).withColumn("score", F.lit(1.0)).withColumn("g", F.lit(0))
    kept = composed(own, "g", "chunk_id", 3, 2, 0.1).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in kept} == {1: 2, 2: 2, 3: 1}
