"""Exact quantiles by sketched brackets; cuts through equal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import sampling, stats


@pytest.mark.parametrize("accuracy, most", [(10_000, 1_000_000), (10, 5), (3, 1)])
def test_quantiles_of_many_shapes(spark, monkeypatch, accuracy, most):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    monkeypatch.setattr(stats, "MAX_BRACKET_VALUES", most)
    rng = np.random.default_rng(1)
    n = 400
    data = {"normal": rng.normal(0, 1, n), "tail": rng.lognormal(0, 6, n), "ties": rng.integers(0, 3, n).astype(float), "equal": np.full(n, 7.0),
            "mostly": np.where(rng.random(n) < 0.9, 1.0, rng.normal(0, 1, n)), "one": np.r_[5.0, np.full(n - 1, np.nan)], "none": np.full(n, np.nan),
            "inf": np.r_[np.inf, -np.inf, rng.normal(0, 1, n - 2)], "holes": np.where(rng.random(n) < 0.3, np.nan, rng.random(n))}
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in np.column_stack(list(data.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data))
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = stats.exact_quantiles(df, list(data), probs)
    for c, v in data.items():
        v = v[~np.isnan(v)]
        want = [None] * len(probs)
        if len(v):
            v, want = np.sort(v), []
            for p in probs:
                h = (len(v) - 1) * p
                a, b, d = v[int(h)], v[min(int(h) + 1, len(v) - 1)], h - int(h)
                want.append(a if d == 0 or a == b else a + (b - a) * d)
        assert got[c] == pytest.approx(want, rel=1e-12) if len(v) else got[c] == want, c


def test_quantiles_bring_a_row_for_each_rank(spark, monkeypatch):
    brought = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: brought.append(collect(self)) or brought[-1])
    df = spark.range(200_000).select(*[F.rand(i).alias(f"c{i}") for i in range(20)])
    got = stats.exact_quantiles(df, df.columns, [0.25, 0.5])
    assert all(abs(a - 0.25) < 0.01 and abs(b - 0.5) < 0.01 for a, b in got.values())
    assert max(map(len, brought)) <= 20 * 4


def test_split_of_equal_rows(spark, monkeypatch):
    brought = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: brought.append(collect(self)) or brought[-1])
    df = spark.range(300_000).select(F.lit("x").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("t")).union(spark.createDataFrame([("y", "a")] * 7, "v string, t string"))
    for stratify in (False, True):
        out = sampling.split(df, "t", [], test_size=0.25, stratify=stratify)
        got = {(r.t, r.v, r.split): r.n for r in out.groupBy("t", "v", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sum(n for (_, _, s), n in got.items() if s == "test") == 75_002
        assert {(t, v): sum(n for (a, b, _), n in got.items() if (a, b) == (t, v)) for t, v, _ in got} == {("a", "x"): 100_000, ("b", "x"): 200_000, ("a", "y"): 7}
        assert out.columns == ["v", "t", "split"]
    assert max(map(len, brought)) < 5000
    few = sampling.undersample(df.where("v = 'x'"), "t", [])
    assert {r.t: r["count"] for r in few.groupBy("t").count().collect()} == {"a": 100_000, "b": 100_000}


def test_too_many_classes_are_refused(spark):
    from tabforge.errors import DataError
    from tabforge.operators import encode, metrics
    df = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("t"), F.col("id").cast("double").alias("x"))
    for call in (lambda: encode.label_classes(df, "t"), lambda: stats.target_corr(df, ["x"], "t"), lambda: metrics.confusion(df, "t", "t")):
        with pytest.raises(DataError):
            call()
    few = df.where("x < 3").union(spark.createDataFrame([(None, 1.0)], "t string, x double"))
    assert encode.label_classes(few, "t") == ["c0", "c1", "c2"]
    assert stats.target_corr(few.where("t IS NULL"), ["x"], "t") == {"x": None}


def test_hash_rank_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS_PER_BUCKET", 2)
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("g"))
    ranked = sampling.hash_rank(df, ["id"], by="g", n_max=500).collect()
    order = sampling.row_order(df, ["id"], 42)[0]
    hashes = {r.id: r.h for r in df.select("id", order.alias("h")).collect()}
    for g in "012":
        line = sorted((r for r in ranked if r.g == g), key=lambda r: r["__rank"])
        assert [r["__rank"] for r in line] == list(range(len(line))) and [hashes[r.id] for r in line] == sorted(hashes[r.id] for r in line)
