"""Model training, search and candidate bookkeeping with Spark ML.

Models are Spark ML estimators fitted on DataFrames (distributed), never
pandas.  Parameters use the familiar names (``C``, ``n_estimators``,
``max_depth``, ...) and are translated to Spark ``Param``s:

* LR ``C`` -> ``regParam = 1 / (C * n_fit)`` with ``standardization=False``;
  ``penalty`` l2/l1/none -> ``elasticNetParam`` 0/1 / ``regParam`` 0.  In a
  grid search one ``regParam`` per grid point is used for all folds, with
  ``n_fit`` the average fold-training size.
* ``max_depth=None`` -> 30 (Spark's maximum); trees bin features
  (``maxBins`` 32), so results are comparable, not equal, to exact-split trees.
* ``solver``, ``n_jobs`` are accepted and ignored (reported back).
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import (CV_FOLDS, DEFAULT_SEED, MAX_CANDIDATES, MAX_GRID_COMBINATIONS,
                                TUNABLE_PARAMS, VALIDATION_SIZE)
from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col
from tabforge.operators import binned, checks, sampling
from tabforge.operators.encode import label_classes, label_index
from tabforge.session import cut_lineage

ALGORITHMS = tuple(TUNABLE_PARAMS)
IGNORED = {"solver", "n_jobs", "verbose", "warm_start"}
MAX_TREE_DEPTH = 30
PARALLEL_FIT_ROWS = 2_000_000       # a search fits one model at a time on more rows
COUNTED_ROWS = 2_000_000            # boosted trees, and a search's forests, are grown on counted bins on more rows


class _NoSummary:
    """Fitted models without their training summary.  It holds the session, which
    cannot be sent to tasks once it has observed a metric, and is never read here."""

    def _fit(self, dataset):
        model = super()._fit(dataset)
        model._java_obj.setSummary(dataset.sparkSession._jvm.scala.Option.apply(None))
        return model


class _PlainLogisticRegression(_NoSummary, LogisticRegression):
    pass


class _PlainRandomForest(_NoSummary, RandomForestClassifier):
    pass


def validate_algorithm(name: str) -> str:
    """The algorithm's own name, whatever case and separators it was given in."""
    found = "_".join(re.findall(r"[a-z0-9]+", str(name).lower()))
    if found in ALGORITHMS:
        return found
    raise ParamError(f"No algorithm is called {name!r}; there are {sorted(ALGORITHMS)}.")


def _mapping(given, what: str) -> dict:
    """A dict, or JSON text of an object; empty or missing ones raise (I4)."""
    if isinstance(given, str):
        try:
            given = json.loads(given) if given.strip() else {}
        except json.JSONDecodeError as e:
            raise ParamError(f"{what}: not JSON ({e.msg}).") from e
    if not isinstance(given, dict | None):
        raise ParamError(f"{what}: a mapping of names to values is needed, not {type(given).__name__}.")
    if not given:
        raise ParamError(f"{what}: at least one entry is needed.")
    return dict(given)


def parse_params(params) -> dict:
    """Estimator parameters from a dict or JSON text (JSON null is None)."""
    return _mapping(params, "Parameters")


def parse_grid(grid) -> dict[str, list]:
    """A search grid: every parameter with the list of its values."""
    out = _mapping(grid, "Grid")
    wrong = [k for k, v in out.items() if not (isinstance(v, list) and v)]
    if wrong:
        raise ParamError(f"Grid: {wrong} need lists with at least one value.")
    return out


def grid_size(grid: dict[str, list]) -> int:
    return math.prod(len(v) for v in grid.values()) if grid else 0


def grid_points(grid: dict[str, list]) -> list[dict]:
    """Grid points in sorted-key order, last key varying fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def check_grid(algorithm: str, grid: dict[str, list], cap: int = MAX_GRID_COMBINATIONS) -> int:
    n = grid_size(grid)
    if n > cap:
        raise ParamError(f"{n} grid combinations for {algorithm} are exceeding max {cap}.")
    return n


def _depth(v) -> int:
    if v is None:
        return MAX_TREE_DEPTH
    if not 0 <= int(v) <= MAX_TREE_DEPTH:
        raise ParamError(f"max_depth {v}: Spark trees have depths from 0 to {MAX_TREE_DEPTH} (None for that limit).")
    return int(v)


def _sampling_rate(v, n_fit: int) -> float:
    """Share of rows for each tree: a float is the share, an integer a number of rows."""
    if v is None:
        return 1.0
    rate = v / max(n_fit, 1) if isinstance(v, int) and not isinstance(v, bool) else float(v)
    if not 0 < rate <= 1:
        raise ParamError(f"max_samples {v}: more rows than the {n_fit} there are, or none.")
    return rate


def estimator(algorithm: str, params: dict, n_fit: int, seed: int = DEFAULT_SEED):
    """Spark estimator for the algorithm with translated parameters."""
    a = validate_algorithm(algorithm)
    p = {k: v for k, v in params.items() if k not in IGNORED}
    seed = int(p.pop("random_state", seed) if p.get("random_state") is not None else seed)
    p.pop("random_state", None)
    common = dict(featuresCol="features", labelCol="label")
    if a == "logistic_regression":
        c = float(p.pop("C", 1.0))
        penalty = p.pop("penalty", "l2")
        est = _PlainLogisticRegression(maxIter=int(p.pop("max_iter", 100)), tol=float(p.pop("tol", 1e-4)),
                                 fitIntercept=bool(p.pop("fit_intercept", True)), standardization=False,
                                 family="binomial", **common)
        if penalty in (None, "none"):
            est.setRegParam(0.0).setElasticNetParam(0.0)
        else:
            est.setRegParam(1.0 / (c * max(n_fit, 1)))
            est.setElasticNetParam({"l2": 0.0, "l1": 1.0}.get(penalty, None)
                                   if penalty in ("l1", "l2") else _bad(f"penalty {penalty}"))
    elif a == "random_forest":
        crit = p.pop("criterion", "gini")
        if crit not in ("gini", "entropy"):
            _bad(f"criterion {crit}")
        rate = _sampling_rate(p.pop("max_samples", None), n_fit)
        est = _PlainRandomForest(numTrees=int(p.pop("n_estimators", 100)), maxDepth=_depth(p.pop("max_depth", None)),
                                     minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
                                     subsamplingRate=rate, impurity=crit, seed=seed,
                                     bootstrap=bool(p.pop("bootstrap", True)), **common)
    else:
        est = GBTClassifier(maxIter=int(p.pop("n_estimators", 100)), stepSize=float(p.pop("learning_rate", 0.1)),
                            maxDepth=_depth(p.pop("max_depth", 3)),
                            minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
                            subsamplingRate=float(p.pop("subsample", 1.0)), seed=seed, **common)
    if p:
        raise ParamError(f"Unsupported parameters for {a}: {sorted(p)}")
    return est


def _bad(msg):
    raise ParamError(f"Unsupported value: {msg}")


# ------------------------------------------------------------------ fitting
@dataclass
class Candidate:
    id: str
    algorithm: str
    method: str
    params: dict
    metrics: dict
    model: PipelineModel
    classes: list[str]
    features: list[str]
    target: str
    seq: int = 0
    extra: dict = field(default_factory=dict)


def _prepared(df: DataFrame, target: str, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    return df.withColumn("label", label_index(F.col(target), classes))


def _assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def weighted_f1(model: PipelineModel, df: DataFrame) -> float:
    pred = model.transform(df)
    return float(MulticlassClassificationEvaluator(metricName="f1", labelCol="label",
                                                   predictionCol="prediction").evaluate(pred))


def validation_split(df: DataFrame, target: str, keys: Sequence[str], seed: int = DEFAULT_SEED,
                     size: float = VALIDATION_SIZE) -> tuple[DataFrame, DataFrame]:
    """H7: stratified 80/20 of the training table (fewer than 2 classes -> error)."""
    counts = sampling.class_counts(df, target)
    if len([c for c in counts if c is not None]) < 2:
        raise DataError("Training data must contain at least two classes.")
    sp = sampling.split(df, target, keys, test_size=size, stratify=True, seed=seed, split_col="__part")
    sp = cut_lineage(sp)
    return sp.where("__part = 'train'").drop("__part"), sp.where("__part = 'test'").drop("__part")


def hash_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Row identity for sampling: the given keys, else every column."""
    return list(keys) if keys else list(df.columns)


def validate_training_data(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    """Binary target, numeric features, no feature nulls; one pass."""
    others = [c for c in df.columns if c != target and c not in keys]
    row = None
    if target in df.columns:
        row = df.agg(F.count_distinct(col(target)).alias("classes"), *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(others)]).first()
    checks.require_binary_target(df, target, row and row["classes"])
    feats = checks.require_numeric_features(df, target, keys)
    found = [{"column_name": c, "null_count": row[f"n{i}"]} for i, c in enumerate(others) if row[f"n{i}"]]
    if found:
        raise DataError(checks.null_report_message(found, "Training data must be null-free."))
    return feats


@dataclass
class TrainingSides:
    """A checked training table split for fitting and validation (H7): what every
    candidate of it is fitted on and judged by."""
    features: list[str]
    classes: list[str]
    fit: DataFrame
    held: DataFrame
    n_fit: int


def training_sides(df: DataFrame, target: str, keys: Sequence[str] = (), seed: int = DEFAULT_SEED) -> TrainingSides:
    feats = validate_training_data(df, target, keys)
    classes = label_classes(df, target)
    fit, held = validation_split(df, target, hash_keys(df, keys), seed)
    return TrainingSides(feats, classes, fit, held, fit.count())


def train_baseline(df: DataFrame, target: str, algorithm: str, params, keys: Sequence[str] = (),
                   seed: int = DEFAULT_SEED, cand_id: str = "candidate_1", sides: TrainingSides | None = None) -> Candidate:
    """Fit on the stratified 80 %, weighted F1 on the 80 % and the 20 %.  ``sides``
    are those of ``df`` where they have been made already."""
    algorithm = validate_algorithm(algorithm)
    params = parse_params(params)
    sides = sides or training_sides(df, target, keys, seed)
    feats, classes, n_fit = sides.features, sides.classes, sides.n_fit
    tr, va = _prepared(sides.fit, target, feats, classes), _prepared(sides.held, target, feats, classes)
    est = estimator(algorithm, params, n_fit, seed)
    points = None
    if algorithm == "gradient_boosting" and n_fit > COUNTED_ROWS and est.getMinInstancesPerNode() == 1 and est.getSubsamplingRate() == 1.0:
        points = binned.count_points(tr, feats, binned.fit_edges(tr, feats))
    if points:
        model = PipelineModel([_assembler(feats), binned.boosted_model(est, points)])
    else:
        model = Pipeline(stages=[_assembler(feats), est]).fit(tr)
    m = {"train_f1_weighted": weighted_f1(model, tr), "validation_f1_weighted": weighted_f1(model, va)}
    return Candidate(cand_id, algorithm, "baseline", params, m, model, classes, feats, target)


_SCORING = {"f1_weighted": ("multi", "f1"), "accuracy": ("multi", "accuracy"),
            "precision_weighted": ("multi", "weightedPrecision"), "recall_weighted": ("multi", "weightedRecall"),
            "roc_auc": ("binary", "areaUnderROC")}


def _evaluator(scoring: str):
    if scoring not in _SCORING:
        raise ParamError(f"Unsupported scoring '{scoring}'. Supported: {sorted(_SCORING)}")
    kind, metric = _SCORING[scoring]
    if kind == "multi":
        return MulticlassClassificationEvaluator(metricName=metric, labelCol="label", predictionCol="prediction")
    return BinaryClassificationEvaluator(metricName=metric, labelCol="label", rawPredictionCol="rawPrediction",
                                         numBins=0)


def tune(df: DataFrame, target: str, algorithm: str, grid, fixed=None, keys: Sequence[str] = (),
         folds: int = CV_FOLDS, scoring: str = "f1_weighted", seed: int = DEFAULT_SEED,
         parallelism: int = 4, cand_id: str = "candidate_1", sides: TrainingSides | None = None) -> Candidate:
    """Stratified 80/20, grid x stratified folds on the 80 %, best mean score
    (first wins ties), refit on the 80 %, validation F1 on the 20 %.  ``sides`` are
    those of ``df`` where they have been made already."""
    algorithm = validate_algorithm(algorithm)
    grid = parse_grid(grid)
    check_grid(algorithm, grid)
    fixed = dict(fixed or {})
    sides = sides or training_sides(df, target, keys, seed)
    feats, classes, tr, va, n_tr = sides.features, sides.classes, sides.fit, sides.held, sides.n_fit
    hk = hash_keys(df, keys)
    _evaluator(scoring)
    n_fit = int(round(n_tr * (folds - 1) / folds))
    points = grid_points(grid)
    # one estimator per grid point (regParam depends on C)
    ests = [estimator(algorithm, {**fixed, **pt}, n_fit, seed) for pt in points]
    edges = None
    if algorithm == "random_forest" and n_tr > COUNTED_ROWS:
        edges = binned.fit_edges(_prepared(tr, target, feats, classes), feats)
    tr = _prepared(sampling.kfold(tr, target, hk, k=folds, seed=seed, fold_col="__fold"), target, feats, classes)
    va = _prepared(va, target, feats, classes)
    counted = binned.count_points(tr, feats, edges, "__fold") if edges else None
    if counted and binned.room(counted, ests, folds):
        scores, model, train_f1 = _search_counted(df.sparkSession, counted, ests, folds, scoring)
    else:
        scores, model, train_f1 = _search_rows(tr, feats, ests, folds, scoring, parallelism if n_tr <= PARALLEL_FIT_ROWS else 1, seed)
    best = _first_best(scores)
    best_model = PipelineModel([_assembler(feats), model])
    m = {"best_cv_score": float(scores[best]), "validation_f1_weighted": weighted_f1(best_model, va),
         "train_f1_weighted": train_f1, "grid_size": len(points)}
    return Candidate(cand_id, algorithm, "grid_search", {**fixed, **points[best]}, m, best_model, classes,
                     feats, target, extra={"cv_scores": scores, "grid": points})


def _first_best(scores: Sequence[float]) -> int:
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def _search_rows(tr: DataFrame, feats: Sequence[str], ests: Sequence, folds: int, scoring: str, parallelism: int, seed: int):
    """Mean scores of the estimators, the best one fitted on all rows, its F1 there."""
    # folds are kept and read by every fit, so they hold no more than fits read
    tr = cut_lineage(_assembler(feats).transform(tr).select("features", "label", "__fold"))
    # the CV sees the estimators as a single Param "stages" swap via a small wrapper pipeline per point
    base = Pipeline(stages=[ests[0]])
    maps = [{base.stages: [e]} for e in ests]
    # fits at once keep a copy of the rows each: many rows fill the cluster with one fit alone
    cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=_evaluator(scoring),
                        foldCol="__fold", numFolds=folds, parallelism=parallelism, seed=seed)
    cvm = cv.fit(tr)
    return [float(x) for x in cvm.avgMetrics], cvm.bestModel.stages[-1], weighted_f1(cvm.bestModel, tr)


def _search_counted(spark, points: binned.Points, ests: Sequence, folds: int, scoring: str):
    """The same of random forests that are grown on counted bins."""
    metric = _SCORING[scoring][1]
    scores = []
    for trees in binned.grow_forests(spark, points, ests, range(folds)):
        held = [points.fold == f for f in range(folds)]
        by_fold = [binned.evaluate(points.label[h], points.n[h], binned.votes(trees[f], points.bins[h]), metric) for f, h in enumerate(held)]
        scores.append(sum(by_fold) / folds)
    est = ests[_first_best(scores)]
    trees = binned.grow_forests(spark, points, [est], [folds])[0][folds]
    f1 = binned.evaluate(points.label, points.n, binned.votes(trees, points.bins), "f1")
    return scores, binned.forest_model(spark, est, trees, points.edges), f1


# --------------------------------------------------------------- candidates
def _known(c: Candidate, *names: str) -> float:
    """The first of the metrics that is there (0.0 is a value); -1 without any."""
    return next((c.metrics[n] for n in names if c.metrics.get(n) is not None), -1.0)


class CandidateRegistry:
    """Ordered candidate list with the best-candidate seat."""

    def __init__(self, cap: int = MAX_CANDIDATES):
        self.cap = cap
        self.items: list[Candidate] = []
        self.best_id: str | None = None

    def next_id(self) -> str:
        if len(self.items) >= self.cap:
            raise ParamError(f"At most {self.cap} training candidates are kept.")
        return f"candidate_{len(self.items) + 1}"

    def add(self, c: Candidate) -> Candidate:
        self.next_id()
        c.seq = len(self.items) + 1
        self.items.append(c)
        cur = self.get(self.best_id)
        if cur is None:
            self.best_id = c.id
        elif c.method != "baseline":
            if _known(c, "validation_f1_weighted") >= _known(cur, "validation_f1_weighted"):
                self.best_id = c.id
        return c

    def get(self, cid: str | None) -> Candidate | None:
        return next((c for c in self.items if c.id == cid), None)

    def best(self, explicit: str | None = None, policy: str = "reference") -> Candidate:
        if not self.items:
            raise DataError("No training candidates.")
        if explicit:
            c = self.get(explicit)
            if c is None:
                raise ParamError(f"Unknown candidate '{explicit}'.")
            return c
        if policy == "reference" and self.best_id:
            return self.get(self.best_id)

        # the first of the highest, by validation F1 or else by the search's score
        return max(self.items, key=lambda c: _known(c, "validation_f1_weighted", "best_cv_score"))

    def frame(self, spark) -> DataFrame:
        rows = [(c.seq, c.id, c.algorithm, c.method, json.dumps(c.params, sort_keys=True, default=str),
                 c.metrics.get("train_f1_weighted"), c.metrics.get("validation_f1_weighted"),
                 c.metrics.get("best_cv_score"), c.id == self.best_id) for c in self.items]
        return spark.createDataFrame(rows, "seq int, candidate_id string, algorithm string, method string, "
                                           "params string, train_f1 double, validation_f1 double, "
                                           "best_cv_score double, is_best boolean")


def save_bundle(c: Candidate, path: str, schema: list[dict] | None = None, extra: dict | None = None) -> None:
    """Model via Spark ML persistence + one-row JSON metadata next to it."""
    c.model.write().overwrite().save(f"{path}/model")
    meta = {"candidate_id": c.id, "algorithm": c.algorithm, "training_method": c.method,
            "params": c.params, "metrics": c.metrics, "classes": c.classes, "features": c.features,
            "target": c.target, "input_schema": schema or [], **(extra or {})}
    from pyspark.sql import SparkSession
    SparkSession.getActiveSession().createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def add_evaluation(spark, path: str, metrics: dict, verdict: str, rationale: str) -> None:
    """Test metrics and the verdict become part of a saved bundle.  They are
    a table of their own beside the model, so the bundle is never half written;
    the last one counts."""
    seq = len(_evaluations(spark, path)) + 1
    entry = {**{k: float(v) for k, v in metrics.items() if v is not None}, "verdict": verdict, "rationale": rationale}
    spark.createDataFrame([(seq, json.dumps(entry))], "seq int, entry string").coalesce(1).write.mode("append").parquet(f"{path}/evaluation")


def _evaluations(spark, path: str) -> list:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema("seq int, entry string").parquet(f"{path}/evaluation").orderBy("seq").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load_bundle(spark, path: str) -> dict:
    meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
    absent = [k for k in ("classes", "features", "target", "input_schema") if k not in meta]
    if absent:
        raise DataError(f"{path}: the bundle lacks {absent}.")
    if added := _evaluations(spark, path):
        meta["evaluation_metrics"] = json.loads(added[-1].entry)
    meta["model"] = PipelineModel.load(f"{path}/model")
    return meta
