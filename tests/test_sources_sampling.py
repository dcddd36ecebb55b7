"""Tables between stages, reproducible sampling, quantiles, parameter rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge import session
from tabforge.errors import DataError, ParamError
from tabforge.operators import encode, metrics, models, sampling, score, select, stats
from tabforge.sources import tables


def test_csv_types_and_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,x,flag,text,,empty\n1,1.5,True,"a, b",p,\n-2,NA,False,NaN,q,\n3,1e3,True,"c ""d""",r,null\n')
    df = tables.load_table(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(-2, None, False, None, "q", None), (1, 1.5, True, "a, b", "p", None), (3, 1000.0, True, 'c "d"', "r", None)]


def test_load_errors(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(DataError):
        tables.load_table(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ParamError):
        tables.load_table(spark, "table.xlsx")
    with pytest.raises(DataError):
        tables.load_table(spark, str(tmp_path / "absent.parquet"))


def test_stage_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1)], "k long, f double, y int")
    assert tables.write_stage(df, f"{tmp_path}/s", ["y"], rows=2) == 2
    assert tables.read_stage(spark, f"{tmp_path}/s", "y", ["k"]).count() == 2
    with pytest.raises(DataError):
        tables.write_stage(df, f"{tmp_path}/s2", rows=3)
    with pytest.raises(DataError):
        tables.read_stage(spark, f"{tmp_path}/s", "absent")
    with pytest.raises(DataError):
        tables.read_stage(spark, f"{tmp_path}/s", "y", ["k", "f"])
    schema = [{"name": "c", "type": "categorical", "categories": ["a", "b"], "drop_first": True, "dummy_columns": ["c_b"]},
              {"name": "f", "type": "numeric", "categories": None, "drop_first": None, "dummy_columns": None}]
    tables.write_schema(spark, schema, f"{tmp_path}/schema")
    assert tables.read_schema(spark, f"{tmp_path}/schema") == schema


def test_checkpoint_folder_is_required_off_local():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = type("C", (), {"get": lambda _, key, default=None: folder})()
            self.sparkContext = type("X", (), {"master": master, "at": None, "getCheckpointDir": lambda x: x.at,
                                               "setCheckpointDir": lambda x, d: setattr(x, "at", d)})()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session("local-cluster[2,1,1024]"))
    assert session.checkpoint_dir(Session("spark://host:7077", "/shared")) == "/shared"
    assert "tabforge-ckpt-" in session.checkpoint_dir(Session("local[2]"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limit", [5000, 20])
def test_split_without_shuffle_is_reproducible(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "CUT_ROWS", limit)
    rng = random.Random(1)
    # a third of the rows has no key, as synthetic rows have
    rows = [(i if i % 3 else None, rng.gauss(0, 1), i % 5 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, x double, y boolean")
    one = sampling.split(df.repartition(3), "y", ["k"], 0.25, stratify=True)
    two = sampling.split(df.repartition(7), "y", ["k"], 0.25, stratify=True)
    assert _rows(one) == _rows(two)
    got = {(r.split, r.y): r["count"] for r in one.groupBy("split", "y").count().collect()}
    assert got == {("train", False): 540, ("train", True): 135, ("test", False): 180, ("test", True): 45}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    ranked = sampling.hash_rank(df, ["k"], 42, by="y")
    assert _rows(ranked.where("__rank < 540 AND NOT y OR __rank < 135 AND y").drop("__rank")) == _rows(one.where("split = 'train'").drop("split"))


def test_equal_rows_are_cut_exactly(spark):
    df = spark.createDataFrame([(None, 1.0, "a")] * 50 + [(None, 1.0, "b")] * 30 + [(1, 2.0, None)], "k long, x double, y string")
    got = {r.y: r["count"] for r in sampling.undersample(df, "y", ["k"]).groupBy("y").count().collect()}
    assert got == {"a": 30, "b": 30}
    assert sampling.undersample(df.limit(0), "y", ["k"]).count() == 0


def test_quantiles_over_extremes(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_BRACKET_VALUES", 50)
    rng = random.Random(2)
    a = [math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1]) for _ in range(2000)] + [math.inf] * 30 + [-math.inf] * 20
    b = [1.0] * 1500 + [1.0 + 2**-52] * 500 + [1e300] * 50
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = stats.exact_quantiles(df, ["a", "b"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    for name, v in (("a", a), ("b", b)):
        v = sorted(v)
        for p, q in zip([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], got[name]):
            h = (len(v) - 1) * p
            lo, hi = v[math.floor(h)], v[min(math.floor(h) + 1, len(v) - 1)]
            assert q == pytest.approx(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)), rel=1e-12)


def test_auc_does_not_overflow(spark, monkeypatch):
    scores = spark.createDataFrame([(0.1, 0, 5 * 10**9), (0.9, 5 * 10**9, 0)], "s double, pos long, neg long")
    monkeypatch.setattr(metrics, "_score_counts", lambda *a: scores)
    assert metrics.roc_auc(None, "", "", "").first().auc == 1.0


def test_scores_that_are_absent(spark):
    df = spark.createDataFrame([("p", 0.9), ("n", 0.1), ("p", None), ("n", float("nan"))], "y string, s double")
    assert metrics.roc_auc(df, "y", "s", "p").first().auc == 1.0


def test_many_categories(spark):
    df = spark.range(2500).select(F.concat(F.lit("v"), "id").alias("c"), (F.col("id") % 2).alias("y"))
    groups = encode.fit_one_hot(df, "y")
    assert len(groups["c"]["dummies"]) == 2500
    with pytest.raises(DataError):
        encode.fit_one_hot(df, "y", max_categories=1000)


def test_parameters_are_not_clamped():
    with pytest.raises(ParamError):
        models.estimator("random_forest", {"max_depth": 40}, 100)
    with pytest.raises(ParamError):
        models.estimator("random_forest", {"max_samples": 2.0}, 100)
    assert models.estimator("random_forest", {"max_samples": 1}, 100).getSubsamplingRate() == 0.01
    assert models.validate_algorithm(" Random-Forest ") == "random_forest"
    for bad in (None, "", "[]", "{}", "{", 3):
        with pytest.raises(ParamError):
            models.parse_params(bad)
    with pytest.raises(ParamError):
        models.parse_grid({"a": []})


def test_candidate_with_zero_f1():
    reg = models.CandidateRegistry()
    for i, (f1, cv) in enumerate([(0.0, 0.9), (0.4, None), (None, 0.3)]):
        reg.add(models.Candidate(f"c{i}", "a", "baseline", {}, {"validation_f1_weighted": f1, "best_cv_score": cv}, None, [], [], "y"))
    assert reg.best(policy="score").id == "c1"


def test_redundancy_by_scan():
    rng = random.Random(3)
    for _ in range(50):
        cols = list("abcdef")
        pairs = {(a, b): rng.choice([None, rng.random()]) for i, a in enumerate(cols) for b in cols[i + 1:]}
        target = {c: rng.choice([None, 0.5, rng.random()]) for c in cols}
        gone = set()
        for j, c in enumerate(cols):
            for p in cols[:j]:
                if (pairs[(p, c)] or 0) > 0.5 and not gone & {c, p}:
                    gone.add(c if target[c] is not None and target[p] is not None and target[c] <= target[p] else p)
        assert select.redundancy_walk(cols, pairs, target, 0.5) == sorted(gone)


def test_missing_columns_raise_when_scoring(spark):
    raw = spark.createDataFrame([(1.0,)], "a double")
    bundle = {"features": ["a", "b"], "classes": ["n", "y"], "model": None,
              "input_schema": [{"name": "a", "type": "numeric"}, {"name": "b", "type": "numeric"}]}
    with pytest.raises(DataError, match="b"):
        score.score(raw, bundle)


def test_correlation_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    rows = [(float(a), None if i % 7 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    got = stats.corr_pairs(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    keep = np.array([i % 7 != 0 for i in range(200)])
    assert got[("a", "b")] == pytest.approx(abs(np.corrcoef(x[keep, 0], x[keep, 1])[0, 1]))
    assert got[("a", "c")] == pytest.approx(abs(np.corrcoef(x[:, 0], x[:, 2])[0, 1]))
