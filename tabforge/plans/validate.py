"""Checks of every stage's outputs (C9) as one table.

Each function reads what a stage has written and gives rows ``stage, check,
column_name, n, ok``.  A table that cannot be read is a failed check, not an
error, so one query over all stages shows everything that is wrong.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.constants import MIN_RATIONALE_CHARS, SUPPORTED_METRICS, VERDICTS
from tabforge.operators import checks
from tabforge.operators.gate import deploy_branch

DDL = "stage string, check string, column_name string, n bigint, ok boolean"
BUNDLE_KEYS = ("classes", "features", "target", "input_schema")


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DDL)


def _read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    try:
        df = getattr(spark.read, kind)(path)
        return df if df.columns else None
    except AnalysisException:
        return None


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def table_checks(spark: SparkSession, stage: str, path: str, target: str, keys: Sequence[str] = (), name: str = "") -> DataFrame:
    """A written table exists, has rows, the target with two classes, and numeric
    features without nulls."""
    df = _read(spark, path)
    if df is None:
        return _rows(spark, [(stage, "exists", name or None, 0, False)])
    found = checks.quality_checks(df, target, keys=keys, min_rows=1)
    label = F.concat_ws(".", F.lit(name) if name else F.lit(None).cast("string"), "column_name")
    return found.select(F.lit(stage).alias("stage"), "check", F.nullif(label, F.lit("")).alias("column_name"), "n", "ok")


def prep_checks(spark: SparkSession, table_path: str, schema_path: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    schema = _read(spark, schema_path, "json")
    n = 0 if schema is None else schema.count()
    return table_checks(spark, "prep", table_path, target, keys).unionByName(_rows(spark, [("prep", "schema_fields", None, n, n > 0)]))


def split_checks(spark: SparkSession, folder: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    return _union([table_checks(spark, "split", f"{folder}/{side}", target, keys, side) for side in ("train", "test")])


def train_checks(spark: SparkSession, bundle_path: str, target: str, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The bundle has its keys and the target; each candidate has a validation F1;
    some decision was logged."""
    meta = _read(spark, f"{bundle_path}/meta", "text")
    row = None if meta is None else meta.first()
    found = json.loads(row[0]) if row else {}
    bundle = [("train", "bundle_key", k, int(k in found), k in found) for k in BUNDLE_KEYS]
    bundle.append(("train", "bundle_target", target, int(found.get("target") == target), found.get("target") == target))
    bundle.append(("train", "model", None, 0 if (m := _read(spark, f"{bundle_path}/model/metadata", "text")) is None else 1, m is not None))
    tally = candidates.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("validation_f1").isNull()).alias("without"))
    rows = F.array(F.struct(F.lit("train").alias("stage"), F.lit("candidates").alias("check"), F.lit(None).cast("string").alias("column_name"), F.col("n"), (F.col("n") > 0).alias("ok")),
                   F.struct(F.lit("train").alias("stage"), F.lit("validation_f1").alias("check"), F.lit(None).cast("string").alias("column_name"),
                            F.col("without").alias("n"), (F.col("without") == 0).alias("ok")))
    logged = decisions.where("stage = 'train'").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("train").alias("stage"), F.lit("decisions").alias("check"), F.lit(None).cast("string").alias("column_name"), "n", (F.col("n") > 0).alias("ok"))
    return _union([_rows(spark, bundle), tally.select(F.inline(rows)), logged])


def evaluation_checks(metrics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``metrics`` (a row per split with the four weighted metrics) and ``verdicts``
    (verdict, rationale): all metrics lie in 0..1 on both splits, one verdict is
    there, it is a known one, and its rationale is long enough."""
    spark = metrics.sparkSession
    good = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(m).between(0, 1), F.lit(False)) for m in SUPPORTED_METRICS])
    per = metrics.groupBy("split").agg(F.count_if(good).alias("n"))
    sides = spark.createDataFrame([("train",), ("test",)], "split string")
    first = F.broadcast(sides).join(per, "split", "left").select(F.lit("evaluate").alias("stage"), F.lit("metrics").alias("check"), F.col("split").alias("column_name"),
                                                               F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("ok"))
    v = verdicts.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("verdict").isin(*VERDICTS)).alias("known"),
                     F.count_if(F.length(F.trim("rationale")) >= MIN_RATIONALE_CHARS).alias("reasoned"))
    one = lambda name, c: F.struct(F.lit("evaluate").alias("stage"), F.lit(name).alias("check"), F.lit(None).cast("string").alias("column_name"),
                                   F.col(c).alias("n"), ((F.col(c) == F.col("rows")) & (F.col("rows") == 1)).alias("ok"))
    return first.unionByName(v.select(F.inline(F.array(one("verdict", "known"), one("rationale", "reasoned")))))


def deploy_checks(verdicts: DataFrame, scored: DataFrame | None = None, failure: DataFrame | None = None) -> DataFrame:
    """A verdict to deploy goes with scored rows that all have a prediction, a
    refusal with a failure report that has steps; never the other way round."""
    spark = verdicts.sparkSession
    branch = deploy_branch(verdicts).select("branch")
    has = scored.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("prediction").isNull()).alias("n_blank")) if scored is not None else \
        spark.range(1).select(F.lit(0).cast("long").alias("n_scored"), F.lit(0).cast("long").alias("n_blank"))
    steps = failure.where("section = 'next steps'").agg(F.count(F.lit(1)).alias("n_steps")) if failure is not None else spark.range(1).select(F.lit(0).cast("long").alias("n_steps"))
    all_ = branch.join(F.broadcast(has)).join(F.broadcast(steps))       # one row each
    goes = F.col("branch") == "deploy"
    one = lambda name, n, ok: F.struct(F.lit("deploy").alias("stage"), F.lit(name).alias("check"), F.col("branch").alias("column_name"), F.col(n).alias("n"), ok.alias("ok"))
    return all_.select(F.inline(F.array(
        one("scored_rows", "n_scored", (F.col("n_scored") > 0) == goes), one("predictions", "n_blank", F.col("n_blank") == 0),
        one("remediation", "n_steps", (F.col("n_steps") > 0) != goes))))
