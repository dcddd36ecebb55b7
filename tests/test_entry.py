import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "is_high" in df.columns


def test_oracle_keys_subset():
    from tabforge.plans.catalog import QUERIES
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op")
