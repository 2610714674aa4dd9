"""Queries that SQL can express, against it."""

import duckdb
import pytest

from lexsift.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE)
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf, name, scale):
    sf = sf.replace("sf0.001", scale)
    con = duckdb.connect()
    for name_ in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{sf}/{name_}.parquet')")
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
