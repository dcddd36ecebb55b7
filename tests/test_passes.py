"""How often the steps of reports and fits read their table."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.functions.exprs import trim_all
from tabforge.operators import gate, metrics, sampling, stats


def counting(spark, rows, ddl):
    """A table, and the number of its rows that have been read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, ddl).mapInArrow(run, ddl), read


def test_metrics_and_signals_read_their_table_once(spark):
    rows = [("a" if i % 3 else "b", "a" if i % 5 else "b") for i in range(90)]
    df, read = counting(spark, rows, "y string, p string")
    one = metrics.weighted_metrics(df, "y", "p")
    assert one.first().accuracy == pytest.approx(sum(y == p for y, p in rows) / 90) and one.count() == 1
    assert read.value == 90
    both, read = counting(spark, rows, "y string, p string")
    signals = gate.deploy_signals(one, one, both, "y")
    assert [(r.majority_count, r.minority_count) for r in signals.collect()] == [(60, 30)]
    assert gate.record_verdict(signals, "deploy", "The figures are good enough for it.").count() == 1
    assert gate.failure_report(gate.record_verdict(signals, "deploy", "The figures are good enough for it.")).count() == 0
    assert read.value == 90


def test_cut_in_a_prefix_of_many_rows_takes_two_passes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PREFIX_STEP", 1)
    n = 120_000             # 7,500 rows a prefix
    df, read = counting(spark, [(i,) for i in range(n)], "k long")
    ends, sizes = sampling.find_cuts(df, ["k"], 42, {None: 30_000})
    assert read.value == 2 * n and sizes == {None: n}
    hash_, x, same, inside = ends[None]
    ranked = sampling.hash_rank(spark.range(n).withColumnRenamed("id", "k"), ["k"], 42, rank_col="r").where("r = 29999")
    h, content = sampling.row_order(ranked.select("k"), ["k"], 42)
    assert tuple(ranked.select("k").select(h, content).first()) == (hash_, x) and (same, inside) == (1, 1)


def test_ranks_of_brackets_with_ties_and_extremes(spark):
    values = [-math.inf, -5.0, -5.0, -0.0, 0.0, 1.5, 1.5, 1.5, 2.0, math.inf, None, math.nan]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "`a b` double, n int")
    rank = {"name": "a b", "lo": -5.0, "hi": 1.5}
    targets = [{**rank, "rank": 1}, {**rank, "rank": 4}, {**rank, "rank": 7}, {**rank, "rank": 8}, {**rank, "rank": 0},
               {"name": "a b", "rank": 9, "lo": math.inf, "hi": math.inf}, {"name": "n", "rank": 3, "lo": 0, "hi": 11}]
    # ranks 8 and 0 are outside of their bracket
    assert stats._ranked(df, targets) == {0: -5.0, 1: 0.0, 2: 1.5, 5: math.inf, 6: 3.0}
    q = stats.exact_quantiles(df, ["a b"], [0.25])["a b"]
    assert q == [pytest.approx(-3.75)]


def test_text_is_trimmed_without_a_pattern_unless_it_ends_in_a_line_end(spark):
    texts = [" a b\t\r\n", "", None, "   ", "x \x85", "x   ", "x\t  ", "x  \n", " ", " \x85", "x\x85 y", "é  \x85\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(trim_all(F.col("t")).alias("out"), F.regexp_replace(F.btrim("t", F.lit(" \t\n\x0b\f\r")), r"\s+(?=[\x85  ]\z)", "").alias("by_pattern"))
    assert all(r.out == r.by_pattern for r in got.collect())
    plan = df.select(trim_all(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("regexp_replace")
