"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from weft.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x) + 0.0:.8g}"
    if isinstance(x, datetime.datetime):
        return x.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0
