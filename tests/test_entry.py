import __spark_entry__ as entry


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 30


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
