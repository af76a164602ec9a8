"""Every registered query with an oracle gives DuckDB's rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from quillstream.plans.registry import FLAGSHIP, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query(name, spark, sf, duck):
    df = QUERIES[name].run(spark, sf)
    want = duck.sql(QUERIES[name].sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_flagship(spark, sf):
    assert FLAGSHIP(spark, sf).count() > 0
