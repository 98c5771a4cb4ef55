import datetime

import pytest
from lodestone.functions import columns as c
from lodestone.functions import python as p
from lodestone.operators import governance as g
from lodestone.operators.documents import chunk_spans
from lodestone.operators.operations import decided
from lodestone.sources import tables
from pyspark.sql import functions as F


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_wilson(spark):
    rows = spark.createDataFrame([(35, 35), (0, 10), (0, 0), (7, 10)], "k int, n int").select(*[x.alias(n) for x, n in zip(c.wilson("k", "n"), ("low", "high"))]).collect()
    assert round(rows[0].low, 3) == 0.901 and rows[0].high == 1.0  # a published worked example
    assert rows[1].low == 0.0 and rows[2].low is None and rows[3].low < 0.7 < rows[3].high


def test_scalars(spark):
    assert one(spark, c.initials("x"), x="ann  bo cy") == "AB"
    assert one(spark, c.safe_name("x"), x="../my file?.pdf") == "my_file_.pdf"
    assert one(spark, c.strict_date("x"), x="2024-02-30") is None
    assert one(spark, c.strict_date("x"), x="2024-02-29") == datetime.date(2024, 2, 29)
    assert one(spark, c.copenhagen_day(F.to_timestamp(F.lit("2024-06-01 23:30:00")))) == datetime.date(2024, 6, 2)
    assert one(spark, c.backoff_seconds("x"), x=3) == 120
    assert one(spark, c.gain("x"), x=[3, 0, 1]) == pytest.approx(7 + 0.5)
    assert one(spark, c.cosine("x", "y"), x=[0.0, 0.0], y=[1.0, 2.0]) == 0.0
    assert one(spark, p.nfc("x"), x="é   a") == "é a"


def test_hash_embedding():
    assert p.fnv1a("") == 2166136261 and p.fnv1a("a") == 0xE40C292C
    assert p.embed("", 4).tolist() == [1, 0, 0, 0]
    words = ["hej", "på", "dig", "𝒜bc"]
    want = [0.0] * 32
    for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        want[p.fnv1a(token) % 32] += -1 if p.fnv1a(token) >> 31 else 1
    size = sum(x * x for x in want) ** 0.5
    assert p.embed("Hej på, dig 𝒜bc", 32).tolist() == pytest.approx([x / size for x in want], abs=6e-7)
    assert p.embed("Hej verden, hej", 64) @ p.embed("hej VERDEN hej", 64) == pytest.approx(1, abs=1e-5)


def test_embeddings_of_a_batch_have_six_decimals():
    texts = ["", "hej", "hej du der", "§ 1 hej hej", "..."]
    made = p.embeddings(texts, 16)
    assert all((made[i] == p.embed(t, 16)).all() for i, t in enumerate(texts))
    assert (abs(made * 1e6 - (made * 1e6).round()) < 1e-6).all() and made[0].tolist() == made[4].tolist() == [1] + [0] * 15


def test_sentences():
    text = "Det koster ca. 5 kr. og mere. Se f.eks. her! Er det nok? ja. Slut"
    assert [text[a:b] for a, b in p.sentence_spans(text)] == ["Det koster ca. 5 kr. og mere.", "Se f.eks. her!", "Er det nok? ja.", "Slut"]
    assert p.sentence_spans("") == p.sentence_spans("  \n ") == []
    for word in p.ABBREVIATIONS:
        assert p.sentence_spans(f"Den gælder {word} Aftalen.") == [(0, len(f"Den gælder {word} Aftalen."))]
    text = 'Se § 4.  (Ja!) "Nej." ærligt. Ærligt?) 7 stk. Én.'
    assert [text[a:b] for a, b in p.sentence_spans(text)] == ["Se § 4.", "(Ja!)", '"Nej." ærligt.', "Ærligt?)", "7 stk. Én."]


def test_masking():
    text, count, held = p.mask("Mail ann@x.dk or ANN@x.dk, call 12 34 56 78; cpr 010203-1234, Bo", ("Bo",))
    assert text == "Mail [EMAIL-1] or [EMAIL-1], call [TELEFON-1]; cpr [CPR-1], [PERSON-1]"
    assert count == {"email": 2, "telefon": 1, "cpr": 1, "person": 1} and held["[CPR-1]"] == "010203-1234"
    cases = {
        "CVR 12345678": "CVR [CVR-1]",
        "cvr-nr.: 12 34 56 78": "cvr-nr.: [CVR-1]",
        "reg 1234 1234567": "reg [KONTO-1]",
        "DK50 0040 0440 1162 43 og DK5000400440116243": "[KONTO-1] og [KONTO-2]",
        "tlf 12345678, Telefon: 87654321": "tlf [TELEFON-1], Telefon: [TELEFON-2]",
        "+45 12345678": "[TELEFON-1]",
        "310299-1234 og 290299-1234": "310299-1234 og [CPR-1]",
        "beløb 12345678": "beløb 12345678",
        "bob og Bobby": "[PERSON-1] og Bobby",
    }
    for text, want in cases.items():
        assert p.mask(text, ("Bob",))[0] == want
    assert p.mask("a@b.dk")[2] == {"[EMAIL-1]": "a@b.dk"}


@pytest.mark.parametrize(("x", "want"), [(0.1, "0.1"), (100.0, "100"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (123456789.125, "123456789.125"), (-0.0, "0"), (1e-6, "0.000001"), (5, "5"), (1.2e22, "1.2e+22"), (-2.5, "-2.5")])
def test_numbers(x, want):
    assert p.number(x) == want


def test_canonical_json(spark):
    assert one(spark, p.canonical_json("x"), x='{"b": [1.0, null], "a": {"ø": "x", "A": true}}') == '{"a":{"A":true,"ø":"x"},"b":[1,null]}'
    assert one(spark, p.canonical_json("x"), x="no") is None


def test_chunks():
    text = "\n".join("Sentence number %d has some words in it, as it should. " % i * 3 for i in range(60)) + "x" * 9000
    spans = chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, _), (a2, b2, again) in zip(spans, spans[1:]):
        assert b - a <= 3200 and a < a2 and b < b2 and again <= 240
        assert not text[b:a2].strip() if not again else b - a2 == again


def test_closure_ends_at_cycles(spark):
    rows = g.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")).collect()
    assert len(rows) == 9 and {r.depth for r in rows if r.ancestor == r.node} == {0}


def test_conflict_closure(spark):
    rows = [(1, "left", "a"), (1, "right", "b"), (2, "left", "b"), (2, "right", "c"), (3, "left", "x"), (3, "right", "y")]
    made = g.conflict_closure(spark.createDataFrame(rows, "conflict int, side string, chunk string"), spark.createDataFrame([("a",)], "chunk string"))
    assert sorted(r.chunk for r in made.collect()) == ["a", "b", "c"]


def test_gate_decisions(spark):
    rows = [("a", 0.95, 0.9, 0.99, ">=", 0.95), ("b", 0.99, 0.96, 1.0, ">=", 0.95), ("c", 0.2, None, None, "<=", 0.1), ("d", None, None, None, ">=", 0.5)]
    made = decided(spark.createDataFrame(rows, "gate string, value double, low double, high double, comparator string, threshold double"))
    assert [r.result for r in made.orderBy("gate").collect()] == ["uncertain", "pass", "fail", "not_measured"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n')
    made = tables.json_lines(spark, str(tmp_path / "x.jsonl"), spark.createDataFrame([], "a int").schema)
    assert sorted((r.line, r.a, r.problem) for r in made.collect()) == [(1, 1, None), (2, None, "not json")]
    new = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, v string")
    assert [tuple(r) for r in tables.absent(new, new.filter("k = 2"), "k", "v").collect()] == [(1, None)]
    for _ in range(2):
        tables.replace_partitions(new.distinct(), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
