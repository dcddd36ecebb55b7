"""Deploy signals, verdicts and the deploy branch.

Signals are a one-row DataFrame: the two one-row metric inputs (train and
test weighted F1) are read as literals, the test class balance is an
aggregation; the suggested verdict is the threshold rule over it.  Recording a verdict or
a failure validates the free-text inputs like the rest of the run log.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import (DEFAULT_REMEDIATION, DEPLOY_MAX_F1_GAP, DEPLOY_MIN_F1, LOW_CONFIDENCE, MIN_RATIONALE_CHARS,
                                SUPPORTED_METRICS, VERDICTS)
from tabforge.errors import ParamError
from tabforge.functions.exprs import col
from tabforge.session import written


def deploy_signals(train_metrics: DataFrame, test_metrics: DataFrame, test_df: DataFrame, target: str,
                   validation_f1: float | None = None, min_f1: float = DEPLOY_MIN_F1,
                   max_gap: float = DEPLOY_MAX_F1_GAP) -> DataFrame:
    """J4 + J5 in one row: F1s, gap, threshold checks, test class balance,
    validation-to-test delta, suggested verdict and the reasons."""
    tr = train_metrics.select(F.col("f1_weighted").alias("train_f1"))
    te = test_metrics.select(F.col("f1_weighted").alias("test_f1"))
    # one row, written, so that nothing made of the signals counts the table again
    bal = written(test_df.where(col(target).isNotNull()).groupBy(col(target)).count()
                  .agg(F.max("count").alias("majority_count"), F.min("count").alias("minority_count")), "balance")
    # the metric inputs are one-row aggregates: their values become literals
    t = tr.collect()[0]["train_f1"]
    e = te.collect()[0]["test_f1"]
    gap = abs(t - e)
    out = bal.select(
        F.lit(t).alias("train_f1"), F.lit(e).alias("test_f1"), F.lit(gap).alias("f1_gap"),
        F.lit(e >= min_f1).alias("test_f1_meets_minimum"), F.lit(gap <= max_gap).alias("f1_gap_within_limit"),
        F.col("majority_count").cast("bigint"), F.col("minority_count").cast("bigint"),
        F.coalesce(F.round(F.try_divide(F.col("minority_count"), F.col("majority_count")), 4),
                   F.lit(1.0)).alias("test_class_ratio"),
        F.lit(None if validation_f1 is None else validation_f1 - e).cast("double")
        .alias("validation_to_test_f1_delta"))
    verdict = F.when(F.col("test_f1_meets_minimum") & F.col("f1_gap_within_limit"), F.lit(VERDICTS[0])) \
        .otherwise(F.lit(VERDICTS[1]))
    reasons = F.concat_ws(
        "; ",
        F.when(~F.col("test_f1_meets_minimum"), F.lit(f"test F1 below {min_f1}")),
        F.when(~F.col("f1_gap_within_limit"), F.lit(f"train-test F1 gap above {max_gap}")))
    return out.withColumn("suggested_verdict", verdict).withColumn("signal_reasons", reasons)


def normalize_verdict(verdict: str) -> str:
    v = " ".join(str(verdict).strip().upper().split())
    if v not in VERDICTS:
        raise ParamError(f"verdict must be one of {VERDICTS}, got '{verdict}'")
    return v


def _rationale(r: str) -> str:
    if not r or len(str(r).strip()) < MIN_RATIONALE_CHARS:
        raise ParamError(f"rationale must be at least {MIN_RATIONALE_CHARS} characters.")
    return str(r).strip()


def record_verdict(signals: DataFrame, verdict: str, rationale: str) -> DataFrame:
    """The issued verdict next to the suggested one (it may override it)."""
    v = normalize_verdict(verdict)
    r = _rationale(rationale)
    return signals.select("test_f1", "f1_gap", "suggested_verdict", F.lit(v).alias("verdict"),
                          (F.col("suggested_verdict") != F.lit(v)).alias("overrides_suggestion"),
                          F.lit(r).alias("rationale"))


def deploy_branch(verdicts: DataFrame) -> DataFrame:
    """Verdict -> branch."""
    return verdicts.withColumn("branch", F.when(F.col("verdict") == VERDICTS[0], "deploy")
                               .otherwise("do_not_deploy"))


def remediation_steps(steps) -> list[str]:
    """Steps from a list, from a JSON list or from the lines of a text; a blank
    text, or none at all, stands for the four default steps."""
    if steps is None or isinstance(steps, str) and not steps.strip():
        return list(DEFAULT_REMEDIATION)
    if isinstance(steps, str):
        try:
            found = json.loads(steps)
            steps = found if isinstance(found, list) else [steps]
        except json.JSONDecodeError:
            steps = steps.splitlines()
    return [str(s).strip() for s in steps if s is not None and str(s).strip()]


def failure_record(spark, rationale: str, steps=None) -> DataFrame:
    """(seq, step) remediation rows; at least one step."""
    _rationale(rationale)
    steps = remediation_steps(steps)
    if not steps:
        raise ParamError("remediation_steps must contain at least one step.")
    arr = F.array(*[F.lit(s) for s in steps])
    return spark.range(1).select(F.posexplode(arr).alias("seq", "step")) \
        .select((F.col("seq") + 1).cast("int").alias("seq"), "step")


def evaluation_context(test_df: DataFrame, target: str, candidate_id: str | None,
                       has_probabilities: bool) -> DataFrame:
    """Test class balance and the evaluation settings as one row."""
    bal = test_df.groupBy(col(target)).count().agg(
        F.count("*").alias("n_classes"), F.max("count").alias("majority_count"),
        F.min("count").alias("minority_count"), F.sum("count").alias("rows"))
    return bal.select("rows", "n_classes", "majority_count", "minority_count",
                      F.lit(candidate_id).alias("candidate_id"),
                      F.lit(DEPLOY_MIN_F1).alias("deploy_min_f1"), F.lit(DEPLOY_MAX_F1_GAP).alias("deploy_max_f1_gap"),
                      F.lit(has_probabilities).alias("has_probabilities"),
                      F.lit(",".join(SUPPORTED_METRICS)).alias("supported_metrics"),
                      F.lit(LOW_CONFIDENCE).alias("confidence_threshold"))


def schema_summary(schema: Sequence[dict], spark) -> DataFrame:
    """Field count, numeric names, categorical names with category counts."""
    num = [s["name"] for s in schema if s["type"] == "numeric"]
    cat = [f"{s['name']}({len(s['categories'])})" for s in schema if s["type"] == "categorical"]
    return spark.createDataFrame([(len(schema), ",".join(num), ",".join(cat))],
                                 "field_count int, numeric_fields string, categorical_fields string")


def failure_report(verdicts: DataFrame, rationale: str | None = None, steps=None) -> DataFrame:
    """Rows ``section, item, value`` of a refused deployment: the metrics and
    the verdict it rests on, the rationale, the numbered steps.  No rows when the
    verdict is to deploy."""
    refused = deploy_branch(verdicts).where("branch = 'do_not_deploy'")
    if rationale is not None:
        _rationale(rationale)
    parts = [("metrics", c, F.format_number(c, 4)) for c in ("test_f1", "f1_gap")]
    parts += [("verdict", c, F.col(c)) for c in ("suggested_verdict", "verdict")]
    parts += [("rationale", "rationale", F.lit(rationale) if rationale is not None else F.col("rationale"))]
    parts += [("next steps", str(i), F.lit(s)) for i, s in enumerate(remediation_steps(steps), 1)]
    rows = [F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.cast("string").alias("value")) for s, i, v in parts]
    return refused.select(F.inline(F.array(*rows)))
