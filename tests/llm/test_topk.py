import random

import duckdb
import pytest
from lodestone.llm.topk import OP5_SQL, exact_top_k, op5_uniform_threshold_search


def plain(rows, k):
    import math

    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        vector = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in good if i != q and len(v) == len(vector))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize(("slices", "rows", "query_rows"), [(1, 7, 2), (2, 64, 3), (5, 1000, 100)])
def test_equals_brute_force(spark, slices, rows, query_rows):
    rng = random.Random(slices)
    data = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for i in range(0, 170)]
    data += [(None, [1.0] * 6), (200, None), (220, []), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6)]
    data += [(40, [2.0] * 6), (41, data[41][1]), (300, [1.0, 2.0]), (301, [3.0, -1.0]), (320, [1e8] * 6), (500, [-1.0] * 6)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string").repartition(3)
    got = exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=5, slices=slices, rows=rows, query_rows=query_rows).collect()
    assert sorted(map(tuple, got)) == sorted(plain(data, 5))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(OP5_SQL).fetchall())
    assert sorted(map(tuple, op5_uniform_threshold_search(spark, sf_dir).collect())) == want


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(none, none).count() == 0


def test_copies_of_query_blocks_are_not_broadcast(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(64)], "x") for i in range(2000)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string").repartition(3)
    made = exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [dim" not in plan and plan.count("SortMergeJoin [dim") == 2  # blocks repeated for every row of the grid
    assert sorted(map(tuple, made.collect())) == sorted(plain([x[:2] for x in data], 5))
