"""Every query that has SQL gives the same rows as DuckDB; the others give rows of a steady shape."""

import math

import duckdb
import pytest

from tilth import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 4) + 0.0
    return str(v)


def key(row):
    return [(str(type(x)), x) for x in row]


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    res = duck.sql(plans.ORACLE_SQL[name])
    at = [res.columns.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in res.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4), (a, b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_rows_only(spark, name):
    rows = plans.QUERIES[name](spark, DATA)
    assert len(rows.collect()) >= 0 and len(set(rows.columns)) == len(rows.columns)
