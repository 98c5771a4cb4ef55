import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm.best_fit import Gaps, best_fit, op11_best_fit_packing, pack_best_fit, placement
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Gaps that are left when pieces go one after the other into the tightest open sequence."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else size
        bisect.insort(gaps, gap - n)
    return gaps


def laid_out(counts, size):
    fills = defaultdict(list)
    steps = sorted(placement(counts, size))
    for i, (length, rank, first, each, offset) in enumerate(steps):
        last = i + 1 == len(steps) or steps[i + 1][0] != length
        for d in range((counts[length] if last else steps[i + 1][1]) - rank):
            fills[first + d // each].append((offset + d % each * length, length))
    return fills


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300))
def test_runs_equal_pieces_one_by_one(lengths):
    fills = laid_out(Counter(lengths), 40)
    for places in fills.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(fills) == list(range(len(fills)))
    assert sorted(40 - sum(n for _, n in x) for x in fills.values()) == one_by_one(lengths, 40)


def test_steps_dont_grow_with_pieces():
    random.seed(1)
    counts = {n: random.randrange(1, 10**9) for n in range(1, 2049)}
    assert len(placement(counts, 2048)) < 12_000


def test_tightest_gap():
    gaps = Gaps(100)
    assert gaps.tightest(1) is None
    for x in (5, 17, 17, 100):
        gaps.add(x, 1)
    assert [gaps.tightest(x) for x in (1, 5, 6, 17, 18, 100)] == [5, 5, 17, 17, 100, 100]
    gaps.add(17, -2)
    assert gaps.tightest(6) == 100


def check(rows, docs, end, size):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    want = Counter()
    lengths = []
    for doc_id, text in docs:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            want[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
            lengths.append(len(own))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in x) for x in places.values()) == one_by_one(lengths, size)


def test_query(spark, sf_dir, documents):
    rows = op11_best_fit_packing(spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 0, 2048)


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_odd_documents(odd_docs, size):
    got = pack_best_fit(odd_docs, PATH, size=size).collect()
    check(got, [(r.doc_id, r.text) for r in odd_docs.collect()], 0, size)


def test_no_documents(no_docs):
    assert pack_best_fit(no_docs, PATH).collect() == []


def test_partitions_dont_matter(spark):
    items = spark.range(5000).select((F.col("id") * F.col("id") % 701 + 1).alias("length"), "id")
    made = []
    for parts in (1, 7):
        numbered = items.withColumn("part", F.col("id") % parts).withColumn("nth", F.row_number().over(_by("part", "length")).cast("long") - 1)
        got = best_fit(numbered, 800).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        made.append(sorted(r.n for r in got))
    assert made[0] == made[1]


def _by(*columns):
    from pyspark.sql import Window

    return Window.partitionBy(*columns).orderBy("id")
