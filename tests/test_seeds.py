"""Occurrences of patterns against a plain search at every place."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.operators.seeds import CLASSES, kept_grams, kept_of_all, occurrences


def plain(texts, patterns):
    return sorted((k, i, at + 1) for k, t in texts if t for i, p in patterns if p for at in range(len(t)) if t.startswith(p, at))


def found(spark, texts, patterns):
    t = spark.createDataFrame(texts, "doc string, text string").repartition(3)
    p = spark.createDataFrame(patterns, "item long, pattern string")
    return sorted((r.doc, r.item, r.at) for r in occurrences(t, p, "doc", "item").collect())


def test_all_lengths_and_overlaps(spark):
    random.seed(2)
    texts = [(f"t{i}", "".join(random.choices("abÅ ", (8, 4, 1, 2), k=n))) for i, n in enumerate((0, 1, 5, 40, 300, 900))]
    texts += [("repeats", "ab" * 150), ("one", "a" * 200), ("none", None), ("wide", "x𝒜y" * 60)]
    patterns = [(n, texts[5][1][100 : 100 + n]) for n in (*range(1, 30), 63, 64, 65, 120, 400)]
    patterns += [(1000, "ab" * 40), (1001, "a" * 70), (1002, ""), (1003, None), (1004, "y" + "x𝒜y" * 30), (1005, "not there at all, whatever comes"), (1006, "a" * 70)]
    assert found(spark, texts, patterns) == plain(texts, patterns)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abå𝒜", max_size=90), max_size=12), st.sampled_from(CLASSES))
def test_texts_keep_the_same_alone_and_together(texts, cls):
    rows, places, hashes = kept_of_all(texts, *cls[1:])
    alone = [(i, a, h) for i, t in enumerate(texts) for a, h in zip(*(x.tolist() for x in kept_grams(t, *cls[1:])), strict=True)]
    assert list(zip(rows.tolist(), places.tolist(), hashes.tolist(), strict=True)) == alone


def most_rows(plan):
    """The most rows that a join of an executed plan gave."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return most_rows(plan.executedPlan())
    if "QueryStage" in name:
        return most_rows(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    children = plan.children()
    return max([own, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_patterns_that_begin_alike_meet_each_place_once(spark):
    texts = [(f"t{i}", f"see document-{i % 500:04d} and document-{(i * 7) % 500:04d}") for i in range(1000)]
    patterns = [(i, f"document-{i:04d}") for i in range(500)]
    t, p = spark.createDataFrame(texts, "doc string, text string").repartition(3), spark.createDataFrame(patterns, "item long, pattern string")
    made = occurrences(t, p, "doc", "item")
    assert sorted((r.doc, r.item, r.at) for r in made.collect()) == plain(texts, patterns)
    assert most_rows(made._jdf.queryExecution().executedPlan()) <= 10 * len(texts)  # 2 places each; with every pattern at each 1,000,000


def test_no_patterns(spark):
    assert found(spark, [("a", "text")], []) == found(spark, [], [(1, "text")]) == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=150), st.sampled_from(CLASSES), st.integers(1, 40))
def test_parts_of_a_text_keep_the_same(text, cls, part):
    whole, small = kept_grams(text, *cls[1:]), kept_grams(text, *cls[1:], part=part)
    assert np.array_equal(whole[0], small[0]) and np.array_equal(whole[1], small[1])
    _, size, window = cls
    for start in range(len(text) - size - window + 2):
        assert any(start <= x < start + window for x in whole[0])


def test_patterns_of_texts_without_places(spark):
    texts = [("a", "one two one two"), ("b", "two"), ("b", "two"), ("c", None), ("d", "x" * 300)]
    patterns = [(1, "one"), (2, "two"), (3, "xxxxxxxxxxxxxxxxxxxxxxxxxx"), (4, "nowhere")]
    t, p = spark.createDataFrame(texts, "doc string, text string").repartition(2), spark.createDataFrame(patterns, "item long, pattern string")
    got = occurrences(t, p, "doc", "item", places=False)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2), ("b", 2), ("d", 3)]


def test_many_grams_are_shuffled_and_found_all_the_same(spark, monkeypatch):
    from lodestone.operators import seeds

    texts, patterns = [(f"t{i}", f"see document-{i % 50:04d} and abc") for i in range(80)], [(i, f"document-{i:04d}") for i in range(50)] + [(99, "abc")]
    for most in (0, 200_000):
        monkeypatch.setattr(seeds, "BROADCAST", most)
        assert found(spark, texts, patterns) == plain(texts, patterns)


def test_hits_of_many_lengths_come_in_parts(monkeypatch, spark):
    from lodestone.operators import seeds

    monkeypatch.setattr(seeds, "TOGETHER", 40)
    texts = [("t", "ab" * 60), ("u", "ba" * 9)]
    patterns = [(n, ("ab" * 40)[:n]) for n in range(1, 40)]
    assert found(spark, texts, patterns) == plain(texts, patterns)
