"""Every registered query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _same(a, b):
    if a is None or b is None or isinstance(a, float) and math.isnan(a) or isinstance(b, float) and math.isnan(b):
        return (a is None or a != a) == (b is None or b != b)
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-7, abs_tol=2e-5)
    return a == b


def _key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else v) if not isinstance(v, bool) else (False, int(v)) for v in row)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
