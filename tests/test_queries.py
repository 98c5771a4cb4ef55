import math

import duckdb
import pytest
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    return made


def shown(rows, order):
    out = []
    for r in rows:
        r = [r[i] for i in order]
        out.append(tuple(repr(x) if not isinstance(x, float) else f"{x + 0.0:.6f}" if not math.isnan(x) else "nan" for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    got = df.collect()
    made = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in made.description]
    want = made.fetchall()
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert shown(got, [df.columns.index(c) for c in names]) == shown(want, [columns.index(c) for c in names])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
