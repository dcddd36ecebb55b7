"""Scoring raw tables with a promoted model (K1-K4).

The raw -> feature transform is one generated projection (F6).  Logistic
models (and any fixed linear scorer) are scored as plain SQL expressions, so
the whole scoring stays in whole-stage codegen; tree models go through the
Spark ML model's ``transform``.  Both paths are stateless per row, so the
same function scores a Structured Streaming DataFrame (K5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import LOW_CONFIDENCE
from tabforge.errors import ParamError
from tabforge.operators import checks
from tabforge.operators.encode import label_inverse, raw_feature_exprs


def _check_threshold(t: float) -> float:
    if not 0.0 < float(t) < 1.0:
        raise ParamError(f"confidence threshold must be strictly between 0 and 1, got {t}")
    return float(t)


def _finish(df: DataFrame, p1, classes: Sequence[str], threshold: float) -> DataFrame:
    """prediction (label text), probability of class index 1, confidence, low flag."""
    pred_idx = F.when(p1 > 0.5, F.lit(1)).otherwise(F.lit(0))
    conf = F.greatest(p1, 1 - p1)
    return (df.withColumn("p_positive", p1)
              .withColumn("prediction", label_inverse(pred_idx, classes))
              .withColumn("confidence", conf)
              .withColumn("low_confidence", conf < F.lit(threshold)))


def score_linear(raw: DataFrame, schema: list[dict], features: Sequence[str], coefficients: Sequence[float],
                 intercept: float, classes: Sequence[str], threshold: float = LOW_CONFIDENCE,
                 fill: dict | None = None) -> DataFrame:
    """Logistic scoring as one expression: p1 = 1 / (1 + exp(-(b + w . x)))."""
    threshold = _check_threshold(threshold)
    if len(coefficients) != len(features):
        raise ParamError("one coefficient per feature is required")
    fx = raw_feature_exprs(raw, schema, features, fill)
    z = F.lit(float(intercept))
    for w, e in zip(coefficients, fx):
        z = z + F.lit(float(w)) * e
    p1 = 1.0 / (1.0 + F.exp(-z))
    return _finish(raw, p1, classes, threshold)


def score(raw: DataFrame, bundle: dict, threshold: float = LOW_CONFIDENCE, fill: dict | None = None) -> DataFrame:
    """K1-K3: every raw column kept, plus prediction, p_positive, confidence, low_confidence.

    ``bundle`` holds ``model`` (a PipelineModel whose last stage is the
    classifier), ``features``, ``classes`` and ``input_schema``.
    """
    threshold = _check_threshold(threshold)
    feats = list(bundle["features"])
    schema = bundle.get("input_schema") or [{"name": f, "type": "numeric"} for f in feats]
    checks.require_columns(raw, [f["name"] for f in schema])
    clf = bundle["model"].stages[-1]
    if hasattr(clf, "coefficients") and hasattr(clf, "intercept") and clf.numClasses == 2:
        return score_linear(raw, schema, feats, clf.coefficients.toArray().tolist(), clf.intercept,
                            bundle["classes"], threshold, fill)
    tmp = [f"__f{i}" for i in range(len(feats))]
    fx = [e.alias(t) for e, t in zip(raw_feature_exprs(raw, schema, feats, fill), tmp)]
    staged = raw.select("*", *fx)
    vec = VectorAssembler(inputCols=tmp, outputCol="features", handleInvalid="keep").transform(staged)
    out = clf.transform(vec)
    p1 = vector_to_array(F.col("probability"))[1]
    keep = raw.columns
    res = out.select(*[F.col(f"`{c}`") for c in keep], p1.alias("__p1"))
    return _finish(res, F.col("__p1"), bundle["classes"], threshold).drop("__p1")


def low_confidence_count(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("rows"), F.count_if("low_confidence").alias("low_confidence_rows"))


def class_probabilities(scored: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """K4: (keys..., class, probability) per row, highest first within a row."""
    both = F.array(*[F.struct((-p).alias("down"), F.lit(i).alias("idx"), p.alias("probability"))
                     for i, p in enumerate((1 - F.col("p_positive"), F.col("p_positive")))])
    return (scored.select(*[F.col(k) for k in keys], F.explode(F.array_sort(both)).alias("c"))
            .select(*keys, label_inverse(F.col("c.idx"), classes).alias("class"), F.col("c.probability").alias("probability")))
