import random

import numpy as np
import pytest
from lodestone.llm import similar
from lodestone.llm.components import connected_components


def plain_groups(rows):
    """doc_id -> smallest doc_id of its group, for (doc_id, text) rows: all pairs, by the exact similarity of
    their shingle sets."""
    first = {}
    for d, t in sorted(rows):
        first.setdefault(frozenset(similar.shingles((t or "").encode(), 5).tolist()), []).append(d)
    sets = list(first)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 4 * len(x) <= 5 * len(y) and 4 * len(y) <= 5 * len(x) and len(x & y) >= 0.8 * len(x | y):
                up[root(j)] = root(i)
    least = {}
    for i, x in enumerate(sets):
        least[root(i)] = min(least.get(root(i), first[x][0]), *first[x])
    return {d: least[root(i)] for i, x in enumerate(sets) for d in first[x]}


def copies(rng, words, count, edits):
    """Texts of 400 words: `count` originals, each with a copy that has `edits` words changed."""
    for _ in range(count):
        text = [rng.choice(words) for _ in range(400)]
        other = list(text)
        for i in rng.sample(range(0, 400, 5), edits):
            other[i] = "changed"
        yield " ".join(text), " ".join(other)


def test_similar_texts_link_and_others_do_not(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    edits = (2, 4, 8, 20, 40)
    texts = [t for n in edits for pair in copies(rng, words, 60, n) for t in pair]
    kept = {r.doc_id for r in similar.without_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    share = {n: 1 - sum(i in kept for i in range(120 * k + 1, 120 * (k + 1), 2)) / 60 for k, n in enumerate(edits)}
    assert all(i in kept for i in range(0, len(texts), 2))
    assert share[2] == 1  # similarity 0.95
    assert share[4] == 1 and share[8] > 0.9  # 0.9 and 0.82
    assert share[20] < 0.05 and share[40] == 0  # 0.6 and 0.3


def test_exact_jaccard_decides(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    pairs = [p for edits in (8, 9, 10) for p in copies(rng, words, 150, edits)]  # similarity about 0.816, 0.796 and 0.776
    sets = [[set(similar.shingles(t.encode(), 5).tolist()) for t in p] for p in pairs]
    want = {i for i, (a, b) in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "doc_id long, text string")
    kept = {r.doc_id for r in similar.without_similar(docs).collect()}
    got = {i for i in range(len(pairs)) if 2 * i + 1 not in kept}
    assert 150 <= len(want) < 300
    assert got <= want and len(got) > 0.96 * len(want)


@pytest.mark.parametrize("dense", [1, 8, 10_000])
def test_groups_equal_brute_force_jaccard(spark, dense):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(40):
            own = list(base)
            for i in rng.sample(range(300), rng.randrange(14)):
                own[i] = rng.choice(words)
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(plain_groups(rows).values())
    assert {r.doc_id for r in similar.without_similar(docs, dense=dense).collect()} == want and len(want) > 3


def test_odd_bits_never_differ_in_more_than_the_sets_do():
    rng = np.random.default_rng(5)
    for size in (0, 1, 5, 146, 3000):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for own in (0, 1, 20, 500):
            y = np.concatenate([x[own // 2 :], rng.integers(0, 1 << 63, own, dtype=np.uint64)])
            apart = int(np.bitwise_count(similar.odd_bits(x) ^ similar.odd_bits(y)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (own == 0) == (apart == 0)


def test_near_copies_that_are_not_similar_are_no_candidates(spark, monkeypatch):
    """600 texts edited from one, most pairs of which are under 0.8: hardly a pair's sets are compared in vain."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], []
    for _ in range(600):
        own = list(base)
        for i in rng.sample(range(150), rng.randrange(1, 10)):
            own[i] = rng.choice(words)
        texts.append(" ".join(own))
    met, plain = {"candidates": 0, "similar": 0}, similar.cut

    def counted(df, label, free=False):
        made = plain(df, label, free)
        if label in met:
            met[label] += made.count()
        return made

    monkeypatch.setattr(similar, "cut", counted)
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in similar.without_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert kept >= set(want.values()) and len(kept) <= 1.05 * len(set(want.values()))
    assert met["candidates"] < 1.5 * met["similar"]


def test_recall_on_documents(spark):
    """Of all pairs of different documents with a similarity of 0.8 or more, nine in ten and more are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in similar.without_similar(docs).collect()}
    gone = {d for d, least in want.items() if d != least}
    assert kept >= set(want.values()) and len(gone - kept) >= 0.95 * len(gone) > 10


def test_one_component_over_many_partitions(spark):
    """A star, a long path and a dense group, dealt over many partitions."""
    rng = random.Random(4)
    edges = [(5000, i) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(300)]
    edges += [(20_000 + rng.randrange(150), 20_000 + rng.randrange(150)) for _ in range(2000)]
    rng.shuffle(edges)
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long").repartition(40), "u", "v").collect())
    assert all(found[i] == 0 for i in [*range(1, 3000), 5000]) and 0 not in found
    assert all(found[i] == 10_000 for i in range(10_001, 10_301))
    assert len({found.get(i, i) for i in range(20_000, 20_150)}) <= 3
