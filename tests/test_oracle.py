"""Every registered search query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexsift.plans import search_oracle, search_queries

TABLES = "documents labels events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v


@pytest.mark.parametrize("name", search_queries.QUERIES)
def test_query_equals_its_sql(spark, sf, duck, name):
    got = search_queries.QUERIES[name](spark, sf)
    want = duck.execute(search_oracle.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
    assert rows


def test_every_query_has_sql():
    assert search_oracle.ORACLE.keys() == search_queries.QUERIES.keys()
