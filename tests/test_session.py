"""Intermediate tables and their scopes."""

import os

from tabforge.session import drop_written, scratch_tables, written


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_tables_go_but_for_the_kept(spark):
    outside = written(spark.range(3), "outside")
    with scratch_tables(spark) as keep:
        first = written(spark.range(5), "first")
        gone = folder(first)
        second = keep(written(first.selectExpr("id * 2 AS id"), "second"))
        third = written(second, "third")
        dropped = folder(third)
        drop_written(third)
        assert not os.path.exists(dropped)
        with scratch_tables(spark):
            inner = folder(written(spark.range(1), "inner"))
        assert not os.path.exists(inner) and os.path.exists(gone)
        drop_written(outside)
    assert not os.path.exists(gone)
    assert sorted(r.id for r in second.collect()) == [0, 2, 4, 6, 8] and outside.count() == 3


def test_scratch_tables_stay_after_an_error(spark):
    try:
        with scratch_tables(spark):
            table = written(spark.range(2), "table")
            raise KeyError
    except KeyError:
        pass
    assert table.count() == 2
