"""Trees grown on counted bins, against Spark's trees on rows and plain recounts."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabforge.errors import DataError
from tabforge.operators import binned, models

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows of 20 x 8 x 3 values; keys and whole rows repeat, labels overlap."""
    rng = np.random.default_rng(5)
    a, b, c, z = rng.integers(0, 20, 900), rng.integers(0, 8, 900), rng.integers(0, 3, 900), rng.random(900)
    data = [(i % 800, float(x) ** 2, float(y) / 4, float(w), int(x + 2 * y + 3 * (v - 0.5) > 16)) for i, (x, y, w, v) in enumerate(zip(a, b, c, z))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, t int").cache()


def counted(rows, fold=None):
    table = rows.withColumn("label", F.col("t").cast("double"))
    return binned.count_points(table, FEATS, binned.fit_edges(table, FEATS), fold)


def vectors(rows):
    return VectorAssembler(inputCols=FEATS, outputCol="features").transform(rows.withColumn("label", F.col("t").cast("double")))


def test_edges_and_counts(spark, rows):
    p = counted(rows)
    assert [len(e) for e in p.edges] == [19, 7, 2] and p.edges[1][0] == 0.125
    assert p.n.sum() == 900 and len(p.n) < 900
    many = spark.range(5000).select((F.col("id") % 1000).cast("double").alias("v"), F.lit(3.0).alias("k"))
    edges, none = binned.fit_edges(many, ["v", "k"])
    sizes = np.bincount(np.searchsorted(edges, np.arange(5000) % 1000, side="left"))
    assert len(sizes) == binned.MAX_BINS and 130 < sizes.min() and sizes.max() < 185 and none == []
    with pytest.raises(DataError, match="no value"):
        binned.fit_edges(many.withColumn("v", F.when(F.col("v") > 3, F.lit(float("nan"))).otherwise(1.0)), ["v", "k"])


@pytest.mark.parametrize("impurity, least, depth", [("gini", 1, 10), ("entropy", 1, 6), ("gini", 7, 10)])
def test_tree_is_sparks_without_chance(spark, rows, impurity, least, depth):
    params = {"n_estimators": 1, "max_depth": depth, "criterion": impurity, "min_samples_leaf": least, "bootstrap": False}
    est, p, v = models.estimator("random_forest", params, 900), counted(rows), vectors(rows)
    theirs = est.fit(v)
    trees = binned.grow_forests(spark, p, [est], [9])[0][9]
    ours = binned.forest_model(spark, est, trees, p.edges)
    assert ours.toDebugString.split("\n")[1:] == theirs.toDebugString.split("\n")[1:]
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())
    raw = binned.votes(trees, p.bins)
    for metric, name in (("f1", "f1"), ("accuracy", "accuracy"), ("weightedPrecision", "weightedPrecision"), ("weightedRecall", "weightedRecall")):
        spoken = MulticlassClassificationEvaluator(metricName=name).evaluate(theirs.transform(v))
        assert binned.evaluate(p.label, p.n, raw, metric) == pytest.approx(spoken, abs=1e-12)
    auc = BinaryClassificationEvaluator(numBins=0).evaluate(theirs.transform(v))
    assert binned.evaluate(p.label, p.n, raw, "areaUnderROC") == pytest.approx(auc, abs=1e-12)


def test_forests_share_trees_and_ignore_partitions(spark, rows):
    table = rows.withColumn("fold", F.pmod(F.hash("id"), F.lit(3)))
    p, q = counted(table, "fold"), counted(table.repartition(7), "fold")
    ests = [models.estimator("random_forest", {"n_estimators": n, "max_depth": d, "random_state": 1}, 900) for n, d in ((4, 3), (9, 8), (9, 3))]
    few, all_, low = binned.grow_forests(spark, p, ests, range(3))
    alone = binned.grow_forests(spark, q, ests[:1], range(3))[0]
    for f in range(3):
        for t in range(4):
            assert all(np.array_equal(x, y) for x, y in zip(few[f][t][:3], low[f][t][:3]))
            assert np.array_equal(binned.votes([few[f][t]], p.bins), binned.votes([alone[f][t]], q.bins))
        assert not np.array_equal(binned.votes(all_[f], p.bins), binned.votes(low[f], p.bins))
        # bootstraps hold about as many rows as the fit has, not the same ones twice
        held = p.n[p.fold != f].sum()
        sizes = [t[4][0].sum() for t in all_[f]]
        assert len(set(sizes)) > 3 and abs(np.mean(sizes) - held) < 4 * np.sqrt(held / 9)


def test_boosted_trees_are_sparks(rows):
    est, p, v = models.estimator("gradient_boosting", {"n_estimators": 6, "max_depth": 3}, 900), counted(rows), vectors(rows)
    ours, theirs = binned.boosted_model(est, p), est.fit(v)
    both = ours.transform(v).select("id", *FEATS, F.col("probability").alias("p")).distinct().collect()
    other = {(r.id, r.a, r.b, r.c): r.probability for r in theirs.transform(v).collect()}
    assert all(abs(r.p[1] - other[r.id, r.a, r.b, r.c][1]) < 1e-9 for r in both)
    thresholds = lambda m: [x.strip() for x in m.toDebugString.split("\n") if "If" in x]
    assert thresholds(ours) == thresholds(theirs)


def test_many_rows_take_the_counted_way(spark, rows, monkeypatch, tmp_path):
    """A search and boosted trees fit nothing on rows, and agree with what is fitted on them."""
    grid, fixed = {"n_estimators": [10, 30], "max_depth": [3, 6]}, {"random_state": 42}
    small = models.tune(rows, "t", "random_forest", grid, fixed, keys=["id"], folds=3)
    gbt = {"n_estimators": 5, "max_depth": 3}
    base = models.train_baseline(rows, "t", "gradient_boosting", gbt, keys=["id"])
    monkeypatch.setattr(models, "COUNTED_ROWS", 100)
    monkeypatch.setattr(models, "_search_rows", None)
    monkeypatch.setattr(models.Pipeline, "fit", None)
    big = models.tune(rows, "t", "random_forest", grid, fixed, keys=["id"], folds=3)
    assert big.extra["grid"] == small.extra["grid"]
    assert np.allclose(big.extra["cv_scores"], small.extra["cv_scores"], atol=0.02)
    assert big.metrics["best_cv_score"] == max(big.extra["cv_scores"])
    assert big.metrics["train_f1_weighted"] == pytest.approx(small.metrics["train_f1_weighted"], abs=0.03)
    assert big.model.stages[-1].getNumTrees == big.params["n_estimators"]
    again = models.tune(rows.repartition(5), "t", "random_forest", grid, fixed, keys=["id"], folds=3)
    assert again.extra["cv_scores"] == big.extra["cv_scores"] and again.metrics == big.metrics
    boosted = models.train_baseline(rows, "t", "gradient_boosting", gbt, keys=["id"])
    assert boosted.metrics == pytest.approx(base.metrics, abs=1e-9)
    models.save_bundle(big, str(tmp_path))
    loaded = models.load_bundle(spark, str(tmp_path))["model"]
    assert loaded.transform(rows).exceptAll(big.model.transform(rows)).count() == 0


def test_too_many_points_are_read_as_rows(rows, monkeypatch):
    monkeypatch.setattr(binned, "MAX_POINTS", 100)
    monkeypatch.setattr(models, "COUNTED_ROWS", 100)
    monkeypatch.setattr(models, "_search_counted", None)
    c = models.tune(rows, "t", "random_forest", {"n_estimators": [3], "max_depth": [2]}, keys=["id"], folds=2)
    assert c.model.stages[-1].getNumTrees == 3
    assert models.train_baseline(rows, "t", "gradient_boosting", {"n_estimators": 2}, keys=["id"]).metrics["train_f1_weighted"] > 0.8


def test_candidates_share_one_split(rows, monkeypatch):
    """A training stage checks and splits its table once for all candidates."""
    from tabforge.plans import stages
    made = []
    split = models.validation_split
    monkeypatch.setattr(models, "validation_split", lambda *a, **k: made.append(1) or split(*a, **k))
    lr, rf = ("logistic_regression", {"C": 1.0}), ("random_forest", {"n_estimators": [3], "max_depth": [3]})
    both = stages.train_stage(rows, "t", ["id"], lr, rf).registry.items
    assert len(made) == 1
    alone = [models.train_baseline(rows, "t", *lr, keys=["id"]), models.tune(rows, "t", *rf, fixed={"random_state": 42}, keys=["id"])]
    assert [c.metrics for c in both] == [c.metrics for c in alone]
    nulls = rows.withColumn("b", F.when(F.col("id") > 3, F.col("b")))
    with pytest.raises(DataError, match=r"b=8\. Training data must be null-free"):
        models.validate_training_data(nulls, "t", ["id"])
