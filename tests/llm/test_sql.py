"""Queries of the training-data operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from brindle.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(str, found.fetchall()))
