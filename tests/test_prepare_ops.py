import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge import fixtures as fx
from tabforge.errors import DataError, ParamError
from tabforge.fixtures import LINEITEM_KEYS as LK
from tabforge.operators import checks, encode, normalize, outliers, select, stats
from tabforge.operators.impute import impute


def test_id_like_names():
    match = ["id", "user_id", "userid", "customer_id", "Name", "first-name", "Unnamed: 0", "_c3"]
    keep = ["doc_id", "event_id", "c_name", "o_custkey", "PassengerId", "email_address"]
    assert normalize.detect_id_like(match + keep, target="t") == match
    assert normalize.detect_id_like(["id", "t"], target="id") == []


def test_header_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a ` int, ` a` int")
    with pytest.raises(DataError):
        normalize.normalize_headers(df)


def test_normalize_strings_and_nan(spark):
    df = spark.createDataFrame([(" A\t", float("nan")), ("NaN", 1.0), ("", 2.0), ("None", None)], "s string, x double")
    out = normalize.integrate(df).collect()
    assert [r.s for r in out] == ["a", None, None, None]
    assert [r.x for r in out] == [None, 1.0, 2.0, None]


def test_coerce_numeric_rules(spark):
    df = spark.createDataFrame([("1", "x", "1", 0), ("2.5e1", "y", "abc", 1), (None, None, "3", 0)],
                               "num string, txt string, mixed string, t int")
    with pytest.raises(DataError, match="mixed"):
        normalize.coerce_numeric(df, "t")
    out, conv = normalize.coerce_numeric(df.drop("mixed"), "t")
    assert conv == ["num"]
    assert [r.num for r in out.collect()] == [1.0, 25.0, None]
    with pytest.raises(DataError, match="Non-numeric"):
        normalize.coerce_numeric_strict(df.drop("mixed"), "t")
    # Spark's cast accepts '1d'; the lenient parser must not
    df2 = spark.createDataFrame([("1d",), ("2",)], "v string").withColumn("t", F.lit(1))
    with pytest.raises(DataError):
        normalize.coerce_numeric(df2, "t")


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_numpy(spark, n, monkeypatch):
    rnd = random.Random(n)
    vals = [rnd.choice([rnd.random() * 100, 5.0, None]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    monkeypatch.setattr(stats, "MAX_BRACKET_VALUES", 50)   # force histogram rounds
    got = stats.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    arr = np.array([v for v in vals if v is not None])
    if arr.size == 0:
        assert got == [None, None, None]
    else:
        exp = np.percentile(arr, [25, 50, 75])
        assert np.allclose(got, exp, rtol=1e-12, atol=1e-12)


def test_modes_tie_smallest(spark):
    df = spark.createDataFrame([(3.0, "b"), (1.0, "a"), (3.0, "b"), (1.0, "a"), (None, None)], "x double, s string")
    assert stats.modes(df, ["x"], numeric=True) == {"x": 1.0}
    assert stats.modes(df, ["s"], numeric=False) == {"s": "a"}


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i) * 2 + 1) for i in range(10)], "a double, k double, b double")
    pr = stats.corr_pairs(df, ["a", "k", "b"])
    assert pr[("a", "k")] is None and abs(pr[("a", "b")] - 1.0) < 1e-12


def test_outliers_keep_nulls(spark):
    rows = [(float(i),) for i in range(20)] + [(1000.0,), (None,)]
    df = spark.createDataFrame([(i, *r, i % 2) for i, r in enumerate(rows)], "id int, v double, t int")
    kept = outliers.remove_outliers(df, "t", keys=["id"])
    vs = [r.v for r in kept.collect()]
    assert 1000.0 not in vs and None in vs and len(vs) == 21
    capped = outliers.cap_outliers(df, "t", keys=["id"]).agg(F.max("v")).collect()[0][0]
    q1, q3 = np.percentile(np.arange(20.0).tolist() + [1000.0], [25, 75])
    assert math.isclose(capped, q3 + 3 * (q3 - q1))


def test_impute_median_mode_and_target_rule(spark, sf):
    df = normalize.integrate(fx.fx_nulls(spark, sf))
    out, info = impute(df, "median", "l_linestatus", keys=LK)
    assert checks.null_report(out, "l_linestatus", keys=LK).count() == 0
    assert out.where(F.col("l_linestatus").isNull()).count() == 0
    with pytest.raises(ParamError):
        impute(df, "bogus", "l_linestatus", keys=LK)
    same, _ = impute(df, "skip", "l_linestatus", keys=LK)
    assert same.count() == df.count()


def test_one_hot_drop_first_only_for_two_categories(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("c", "x", 0), (None, "y", 1)],
                               "c3 string, c2 string, t int")
    out, groups = encode.one_hot(df, "t", "one_hot_drop_first")
    assert out.columns == ["c3_a", "c3_b", "c3_c", "c2_y", "t"]
    assert [tuple(r) for r in out.collect()][3] == (0, 0, 0, 1, 1)
    full, _ = encode.one_hot(df, "t", "one_hot_full")
    assert "c2_x" in full.columns


def test_input_schema_unit(spark):
    pre = spark.createDataFrame([(1, 25.0, "red"), (2, 30.0, "blue"), (3, 35.0, "red")], "id int, age double, color string")
    groups = encode.fit_one_hot(pre.drop("id"), "none")
    sch = encode.build_input_schema(pre, groups, ["age", "color_red"], excluded=["id"])
    assert [s["name"] for s in sch] == ["color", "age"]


def test_encode_requires_imputation(spark, sf):
    df = normalize.integrate(fx.fx_nulls(spark, sf))
    with pytest.raises(DataError, match="impute"):
        encode.encode_features(df, "one_hot_drop_first", "l_linestatus", keys=LK)


def test_selection_negative_case(spark, sf):
    df = normalize.integrate(fx.fx_lineitem(spark, sf))
    enc, _ = encode.encode_features(df, "one_hot_drop_first", "l_linestatus", keys=LK)
    with pytest.raises(DataError, match="No features remain"):
        select.filter_by_correlation(enc, "both", "l_linestatus", keys=LK)


def test_redundancy_walk_rules():
    feats = ["a", "b", "c"]
    pair = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.95}
    assert select.redundancy_walk(feats, pair, {"a": 0.5, "b": 0.5, "c": 0.9}, 0.8) == ["b"]
    assert select.redundancy_walk(feats, pair, {"a": float("nan"), "b": 0.5, "c": 0.9}, 0.8) == ["a", "b"]


def test_binary_target_check(spark, sf):
    df = fx.fx_three_class(spark, sf)
    with pytest.raises(DataError, match="exactly 2"):
        checks.require_binary_target(df, "o_orderstatus")
