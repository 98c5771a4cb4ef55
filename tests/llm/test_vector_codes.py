import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from lodestone.llm.vector_codes import OP12_SQL, assignments, compressed, nearest, op12_delta_lloyd_codes, with_total
from pyspark.sql import functions as F


def plain(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with every sum made anew, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts

    def cut(v, p):
        return v[p * width : (p + 1) * width]

    first = [v for _, v in sorted(kept)[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v in kept:
                members[best(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    out = []
    for i, v in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)], f"l{i % 3}" if i % 5 else None) for i in range(300)]
    rows += [(1000 + i, rows[3][1], "hot") for i in range(400)] + [rows[5], rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_rounds_equal_plain_sums(spark, vectors, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        books, coded = compressed(vectors, parts=2, entries=16, rounds=3, scale=64)
        want, plain_books = plain([(r.vec_id, r.embedding) for r in vectors.collect()], 2, 16, 3, 64)
        assert books.tolist() == plain_books
        assert Counter((r.vec_id, bytes(r.code).hex(), r.error) for r in coded.collect()) == Counter(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_changes_are_shuffled_and_nothing_else(spark, vectors):
    from lodestone.llm.vector_codes import _bucketed

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.lit(b"\x01\0\0\0\x09\0\0\0").alias("data")).limit(64)
    stored = _bucketed(numbered.repartition(4, "row"), 4, "test")
    books = np.array([[[1], [9]], [[1], [9]]], dtype=np.int64)
    made = _bucketed(assignments(stored, None, books), 4, "test", "kind")
    deltas = {(r.part, r.entry, r.place): r.delta for r in made.filter("kind = 'delta'").groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")).collect()}
    assert deltas == {(0, 0, 0): 64, (0, 0, 1): 64, (1, 1, 0): 9 * 64, (1, 1, 1): 64}
    before = made.filter("kind = 'code'").select("row", F.col("code").alias("old"))
    assert assignments(stored, before, books).filter("kind = 'delta'").count() == 0
    moved = assignments(stored, before, books[:, ::-1].copy()).filter("kind = 'delta'").groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta"))
    assert {(r.part, r.entry, r.place): r.delta for r in moved.collect()} == {
        (p, e, k): (1 if e == 1 - p else -1) * 64 * (1 if k else (1, 9)[p]) for p in (0, 1) for e in (0, 1) for k in (0, 1)
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = assignments(stored, before, books)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ties_and_large_numbers():
    books = np.array([[[0, 0], [2, 0], [2, 0]]], dtype=np.int64)
    codes, errors = nearest(np.array([[1, 0], [2, 0], [1 << 24, -(1 << 24)]], dtype=np.int32), books)
    assert codes.ravel().tolist() == [0, 1, 1]
    assert errors.ravel().tolist() == [1, 0, ((1 << 24) - 2) ** 2 + (1 << 48)]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    made = con.execute(OP12_SQL)
    names = [x[0] for x in made.description]
    want = sorted(tuple(row) for row in made.fetchall())
    assert sorted(tuple(r[x] for x in names) for r in op12_delta_lloyd_codes(spark, sf_dir).collect()) == want


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, error string, row string"
    good = [(i, [float(i), 1.0, -1.0, 0.5], None if i % 2 else 7, "x", "y") for i in range(9)]
    odd = [
        (20, None, 1, "x", "y"),
        (21, [], 1, "x", "y"),
        (22, [1.0, None, 1.0, 1.0], 1, "x", "y"),
        (23, [1.0, float("nan"), 1.0, 1.0], 1, "x", "y"),
        (24, [1.0, float("inf"), 1.0, 1.0], 1, "x", "y"),
        (25, [1.0] * 8, 1, "x", "y"),
        (26, [1.0] * 5, 1, "x", "y"),
        (27, [1e300, 1.0, 1.0, 1.0], 1, "x", "y"),
    ]
    kept = [*good, (None, [4.0, 1.0, -1.0, 0.5], None, "x", "y")]
    df = spark.createDataFrame([*kept, *odd], schema)
    _, coded = compressed(df)
    rows = coded.collect()
    assert Counter(r.vec_id for r in rows) == Counter(r[0] for r in kept)
    assert all(r.error == 0 for r in rows)  # nine different vectors, an entry for each
    assert compressed(df.limit(0))[1].count() == 0


def test_totals(spark):
    rows = [(None, 1)] * 50 + [("a", 2)] * 30 + [(f"k{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, value long")
    for share in (3, 1000):
        got = Counter((r.key, r.total) for r in with_total(df, "key", "value", "total", share).collect())
        want = Counter({(None, 50): 50, ("a", 60): 30, **{(f"k{i}", i): 1 for i in range(40)}})
        assert got == want


def test_digest():
    from lodestone.llm.vector_codes import book_digest

    assert book_digest(np.array([[[1, -2], [3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
