import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from lodestone.llm.spelling import deletions, op13_symmetric_delete_variants, own_key, roots, runs, variants, word_counts


def plain_counts(docs, shortest=7, fewest=2):
    made = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            made[run] += 1
    return {w: n for w, n in made.items() if len(w) >= shortest and n >= fewest}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(counts):
    words = sorted(counts)
    found = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, some in by_length.items():
        for i, a in enumerate(some):
            for b in [*some[i + 1 :], *by_length.get(n + 1, [])]:
                if near(a, b):
                    found[a].append(b)
                    found[b].append(a)
    form = {}
    for w, others in found.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), counts[w], len(found[w]), counts[form[w]] if w in form else None) for w in words)


def rows(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query(spark, sf_dir, documents):
    want = plain_variants(plain_counts([(r.doc_id, r.text) for r in documents.collect()]))
    got = rows(op13_symmetric_delete_variants(spark, sf_dir))
    assert got == want
    assert sum(1 for x in got if x[1]) > 0


ODD = [
    ("abcdefg", 100_000), ("abcdefgh", 2), ("abcdefh", 9_000), ("abcdefx", 9_000), ("abbcdefg", 100), ("abcddefg", 10_000), ("abcddefgg", 1_000),
    ("aaaaaaa", 20), ("aaaaaaaa", 2), ("aaaabaaa", 2), ("baaaaaa", 2), ("aaaaaab", 200), ("ÿabcdefg", 3), ("ÀÀabcdefg", 3), ("bacdefg", 5),
    ("x" * 5000 + "y", 2), ("x" * 4999 + "y", 30), ("x" * 4999 + "zy", 2), ("zyxwvuts", 2),
]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_odd_words(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame([(w, n, "x") for w, n in ODD], "word string, n long, id string").repartition(3)
        assert rows(variants(df)) == plain_variants(dict(ODD))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_crowded_key(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = "kitchens"
    counts = {word: 10_000}
    for i in range(len(word) + 1):
        for c in letters:
            counts[word[:i] + c + word[i:]] = 2 + len(counts) % 5
            counts[word[:i] + c + word[i + 1 :]] = 2 + len(counts) % 5
    counts[word] = 10_000
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(variants(df)) == plain_variants(counts)


def test_odd_documents(spark, odd_docs, no_docs):
    counts = plain_counts([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert {r.word: r.n for r in word_counts(odd_docs).collect()} == counts
    assert variants(word_counts(no_docs)).collect() == []


@given(st.text("abÀ", min_size=1, max_size=12))
def test_keys_of_deletions(word):
    made = deletions(word)
    assert [key for key, *_ in made] == list(dict.fromkeys(own_key(word[:i] + word[i + 1 :]) for i in range(len(word))))
    assert [i for _, first, last in made for i in range(first, last + 1)] == list(range(len(word)))


@given(st.text("ab -", max_size=60), st.integers(1, 9))
def test_parts_of_a_text(text, step):
    pattern = re.compile("[a-z]{2,}")
    assert sum(runs(text, pattern, step), Counter()) == Counter(pattern.findall(text))


def test_roots_of_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(50, 19), (60, 61)], "id long, form long")
    want = {**dict.fromkeys(range(19), 19), 50: 19, 60: 61}
    assert {r.id: r.root for r in roots(df).collect()} == want
    assert roots(df.limit(0)).collect() == []
