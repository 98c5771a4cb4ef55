import random
import re

import numpy as np
import pytest
import xxhash
from lodestone.llm import simhash
from lodestone.llm.components import _with_least, connected_components


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> smallest id reachable, for (doc_id, fp) rows."""
    fps = sorted({fp for _, fp in rows})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    array = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ np.uint64(f)) <= 3):
            up[root(fps[i + 1 + j])] = root(f)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return sorted((str(d), f"{f:016x}", str(least.get(root(f)))) for d, f in rows)


def test_query_equals_brute_force(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
        assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("dense", [2, 10_000])
def test_links_are_complete(spark, dense):
    rng = random.Random(7)
    fps = {0, 1, 7, 15, (1 << 63), (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            fps.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    for low in range(300):  # one dense segment
        fps.add((123456789 << 32) | rng.getrandbits(10))
    signed = [int(np.array(f, dtype=np.uint64).view(np.int64)) for f in fps]
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense).collect()}
    array = np.array(signed, dtype=np.int64).view(np.uint64)
    want = {frozenset((signed[i], signed[j])) for i in range(len(array)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3) if i != j}
    assert got == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (205, 201), (203, 205), (201, 203)]
    made = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect())
    assert made == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)} | {203: 201, 205: 201}


def broadcast_rows(plan):
    """The most rows that an executed plan sent to every task."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return broadcast_rows(plan.executedPlan())
    if "QueryStage" in name:
        return broadcast_rows(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if name.startswith("BroadcastExchange") else 0
    children = plan.children()
    return max([own, *(broadcast_rows(children.apply(i)) for i in range(children.size()))])


def test_balls_and_parts_are_not_broadcast(spark, tmp_path):
    rng = random.Random(1)
    spark.createDataFrame([(rng.getrandbits(63),) for _ in range(3000)], "fp long").write.parquet(f"{tmp_path}/fps")
    made = simhash.links(spark.read.parquet(f"{tmp_path}/fps").distinct())
    made.collect()
    assert broadcast_rows(made._jdf.queryExecution().executedPlan()) <= 3000  # a ball has 34 rows for each
    spark.createDataFrame([(i, i // 2) for i in range(1, 3000)], "u long, v long").write.parquet(f"{tmp_path}/edges")
    joined = _with_least(spark.read.parquet(f"{tmp_path}/edges"), own=True)[1]
    joined.collect()
    assert broadcast_rows(joined._jdf.queryExecution().executedPlan()) <= 3000  # eight rows for each node
