import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from lodestone.llm.passages import Shard, cut_passages, joined, op7_repeated_phrase_automata, remove_passages

from pyspark.sql import functions as F


def plain(texts, width=35):
    """(n_words, n_removed, sha256 of the kept words, kept words) of each text."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def check(rows, docs, width=35):
    want = sorted((str(d), *x[:3]) for (d, _), x in zip(docs, plain([t for _, t in docs], width)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want


def test_query_equals_brute_force(spark, sf_dir, documents):
    check(op7_repeated_phrase_automata(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd_docs, no_docs):
    made = cut_passages(odd_docs)
    rows = made.select("row.doc_id", "row.n_tokens", F.col("text").alias("old"), "made.*").collect()
    assert all(r.n_tokens == "x" for r in rows)
    check(rows, [(r.doc_id, r.old) for r in rows])
    assert sorted(str((r.doc_id, r.old)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in odd_docs.collect())
    assert all(r.text == (r.old or "") for r in rows if not r.n_removed)
    clash = odd_docs.selectExpr("doc_id", "text", "n_tokens made", "1 row", "2 shard", "3 passage", "array(4) _cut", "map('a', 5) row_key", "n_tokens n_chars")
    gone = remove_passages(clash)
    assert gone.schema.names == clash.schema.names and gone.count() == clash.count()
    assert gone.filter("row <> 1 or shard <> 2 or passage <> 3 or _cut[0] <> 4 or row_key['a'] <> 5").count() == 0
    assert remove_passages(no_docs).count() == 0


def test_shard_finds_what_it_was_not_told():
    """Places come from the automaton: the shard knows passages, not where they are, nor that this text has any."""
    shard = Shard()
    for words, spans in ((b"a b c d e f g", [(0, 5), (2, 7)]), (b"x y x y x", [(0, 5)])):
        shard.add(words, np.array(spans, dtype="<i4").tobytes())
    gone = shard.located(b"q a b c d e f g q x y x y x y x q a b c d".split())
    assert gone.tolist() == [c == "1" for c in "01111111011111110" + "0000"]
    assert not Shard().located([b"a"]).any()


def test_copies_and_a_common_passage(spark):
    """A third of the rows are one text, another third share one passage; shards are many and small."""
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(i, " ".join(f"c{k}" for k in range(90))) for i in range(60)]
    docs += [(100 + i, f"{' '.join(f'd{i}.{k}' for k in range(20))} {passage} {' '.join(f'e{i}.{k}' for k in range(i))}") for i in range(60)]
    docs += [(200 + i, " ".join(f"f{i}.{k}" for k in range(70))) for i in range(60)]
    docs += [(None, docs[0][1])] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = cut_passages(df, shard_bytes=2000).select("row.doc_id", "made.*").collect()
    check(rows, docs)


@pytest.mark.parametrize(("seed", "width", "gram", "letters"), [(1, 5, 2, "ab"), (2, 6, 3, "abc"), (3, 9, 4, "abcdefgh"), (4, 8, 8, "abcd")])
def test_random_texts(spark, seed, width, gram, letters):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(letters) for _ in range(rng.randrange(3, 30))) for _ in range(4)]
    docs = []
    for i in range(120):
        parts = [" ".join(f"{rng.choice(letters)}{rng.randrange(40)}" for _ in range(rng.randrange(0, 25))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        docs.append((i, rng.choice((" ", "\n", "  \t")).join(parts)))
    docs += docs[:10]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = cut_passages(df, width, gram, shard_bytes=3000).select("row.doc_id", "made.*").collect()
    check(rows, docs, width)
    kept = sorted((str(d), x[3]) for (d, _), x in zip(docs, plain([t for _, t in docs], width)))
    assert sorted((str(r.doc_id), r.text.split()) for r in rows) == kept
    for r in rows:
        assert sum(s.words for s in r.spans) == r.n_removed


def test_joined():
    assert joined([4, 5, 0, 1, 2, 6, 9, 3], 35) == [(0, 41), (9, 44)]
