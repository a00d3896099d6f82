"""Every query with oracle SQL against DuckDB on the smallest tables."""

import math
import os
from datetime import datetime

import duckdb
import pytest

from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str | datetime):
        return v
    return round(float(v), 7) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = db.execute(catalogue.oracle_sql()[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())
