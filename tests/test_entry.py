import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert {"query_id", "verdict"} <= set(df.columns)
    assert df.count() > 0


def test_registry():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert all(callable(f) for f in names.values())
