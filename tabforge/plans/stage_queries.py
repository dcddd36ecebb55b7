"""Queries of the stages' tables, checks, reports and fitted preparation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabforge import fixtures as fx
from tabforge.fixtures import LINEITEM_KEYS as LK
from tabforge.operators import candidates, fitted, gate, metrics, models, profile, sampling
from tabforge.operators.encode import build_input_schema, encode_features, schema_frame
from tabforge.operators.normalize import coerce_numeric_strict, integrate
from tabforge.operators.wide_encode import category_index, sparse_dummies
from tabforge.plans import stages, validate
from tabforge.plans.prep import prepare
from tabforge.session import work_path
from tabforge.sources.reports import run_report
from tabforge.sources.runlog import RunLog
from tabforge.sources.tables import continuity_check, logged_write, write_schema, write_stage

#: method and threshold of the rule scorers that stand for trained candidates
RULES = (("baseline", 25.0), ("baseline", 10.0), ("grid_search", 25.0), ("grid_search", 45.0))


def row_continuity(spark, d):
    """A logged table as written, and after its first five rows came again."""
    log, path = RunLog("prep"), work_path(spark, "working")
    logged_write(fx.fx_high(spark, d), path, log, "impute_missing", {"strategy": "median"})
    log.step("profile_dataset", {}, None, None)
    steps = log.steps_frame(spark)
    intact = continuity_check(spark, path, steps, ["handle_outliers", "impute_missing"]).collect()
    spark.read.parquet(path).orderBy(*LK).limit(5).write.mode("append").parquet(path)
    broken = continuity_check(spark, path, steps, ["handle_outliers", "impute_missing"])
    before = spark.createDataFrame([("written", *r) for r in intact], "state string, check string, column_name string, n bigint, ok boolean")
    return before.unionByName(broken.withColumn("state", F.lit("rows repeated")))


def split_written(spark, d):
    """A4, M2: the split stage's two tables, read back and counted."""
    folder = work_path(spark, "split")
    stages.split_stage(fx.fx_high(spark, d).drop("l_returnflag"), "is_high", keys=LK, folder=folder)
    sides = [spark.read.parquet(f"{folder}/{s}").groupBy("is_high").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s)) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


def fitted_apply(spark, d):
    """Split first, fit on the training side, apply a reloaded preparation to the test side."""
    _, test, prep = fitted.leak_free(fx.fx_full(spark, d), "is_big", LK, test_size=0.2, correlation="skip", scale=True)
    path = work_path(spark, "prep")
    prep.save(spark, path)
    again = fitted.FittedPrep.load(spark, path)
    assert again == prep
    return test.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in test.dtypes])


def prep_full_log(spark, d):
    """The run log of a preparation that drops columns, outliers and rows without a target."""
    res = prepare(fx.fx_full(spark, d), "is_big", keys=LK, manual_drops=["user_id"], balance="none", count_steps=True)
    kept = spark.createDataFrame([(99, ",".join(res.features))], "seq int, tool string")
    steps = res.log.steps_frame(spark).select("seq", "tool", "rows_before", "rows_after")
    return steps.unionByName(kept, allowMissingColumns=True)


def _rule_metrics(spark, d, threshold):
    scored = fx.fx_rule_scores(spark, d).withColumn("prediction", F.when(F.col("score") * 50 > threshold, "O").otherwise("F"))
    return metrics.weighted_metrics(scored, "l_linestatus", "prediction")


def candidate_seat(spark, d):
    """Baseline, another baseline, a tied and a worse tuned candidate."""
    folder = work_path(spark, "candidates")
    for method, threshold in RULES:
        f1 = _rule_metrics(spark, d, threshold).first().f1_weighted
        candidates.append_candidate(spark, folder, "rule", method, {"threshold": threshold}, {"validation_f1_weighted": f1})
    table = candidates.read_candidates(spark, folder)
    parts = [candidates.seat(table, p).withColumn("policy", F.lit(p)) for p in candidates.POLICIES]
    parts.append(candidates.seat(table, explicit="candidate_4").withColumn("policy", F.lit("explicit")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("policy", "candidate_id", "method", F.round("validation_f1", 6).alias("validation_f1"))


def _verdict(spark, d):
    from tabforge.plans.catalog import _rule_signals
    return gate.record_verdict(_rule_signals(spark, d), "do not deploy", "The rule scorer is no better than chance on the test split.")


def failure_report(spark, d):
    """J7 with blank steps: the four default ones."""
    return gate.failure_report(_verdict(spark, d), steps="  ")


def stage_failures(spark, d):
    """What the checks say of one broken output of every stage."""
    high = fx.fx_high(spark, d).drop("l_returnflag")
    folder = work_path(spark, "broken")
    write_stage(high.withColumn("l_quantity", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity"))), f"{folder}/cleaned")
    write_schema(spark, [{"name": "l_quantity", "type": "numeric", "categories": None, "drop_first": None, "dummy_columns": None}], f"{folder}/schema")
    write_stage(high, f"{folder}/split/train")
    write_stage(high.limit(0), f"{folder}/split/test")
    meta = json.dumps({"features": ["l_quantity"], "target": "is_high", "input_schema": []})
    spark.createDataFrame([(meta,)], "value string").write.text(f"{folder}/bundle/meta")
    f1 = _rule_metrics(spark, d, 25.0)
    for value in ({"validation_f1_weighted": f1.first().f1_weighted}, {}):
        candidates.append_candidate(spark, f"{folder}/candidates", "rule", "baseline", {"threshold": 25}, value)
    decisions = RunLog("split").decisions_frame(spark)
    verdict = _verdict(spark, d)
    found = [validate.prep_checks(spark, f"{folder}/cleaned", f"{folder}/schema", "is_high", LK), validate.split_checks(spark, f"{folder}/split", "is_high", LK),
             validate.train_checks(spark, f"{folder}/bundle", "is_high", candidates.read_candidates(spark, f"{folder}/candidates"), decisions),
             validate.evaluation_checks(f1.withColumn("split", F.lit("test")), verdict.withColumn("rationale", F.lit("too short"))),
             validate.deploy_checks(verdict, scored=fx.fx_rule_scores(spark, d))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("NOT ok").drop("ok")


def report_rows(spark, d):
    """The report over log, decisions, schema, metrics, verdict and failure."""
    res = prepare(fx.fx_full(spark, d), "is_big", keys=LK, manual_drops=["user_id"], balance="none", count_steps=True)
    log = RunLog("train")
    log.decision("algorithm choice", ["rule", "none"], "rule", "A rule on the quantity needs no training at all.")
    sides = sampling.split(fx.fx_rule_scores(spark, d), "l_linestatus", LK, test_size=0.3, stratify=True)
    both = [metrics.weighted_metrics(sides.where(F.col("split") == s), "l_linestatus", "prediction").withColumn("split", F.lit(s)) for s in ("train", "test")]
    verdict = _verdict(spark, d)
    return run_report(res.log.steps_frame(spark), log.decisions_frame(spark), schema_frame(spark, res.schema), both[0].unionByName(both[1]), verdict, gate.failure_report(verdict))


def evaluation_context(spark, d):
    return gate.evaluation_context(fx.fx_rule_scores(spark, d), "l_linestatus", "candidate_1", False)


def schema_summary(spark, d):
    enc, info = encode_features(integrate(fx.fx_redundant(spark, d)), "one_hot_full", "is_big", keys=LK)
    feats = [c for c in enc.columns if c != "is_big" and c not in LK]
    return gate.schema_summary(build_input_schema(info["pre_encode"], info["groups"], feats, info["excluded"], LK), spark)


def recommended_search(spark, d):
    return profile.recommended_search(fx.fx_high(spark, d), "is_high").select("rows", "algorithm", "position", "parameter", "max_grid_combinations")


def wide_categories(spark, d):
    """Customers' names (one each) and segments as sparse dummies."""
    df = fx.table(spark, d, "customer")
    columns = ["c_name", "c_mktsegment"]
    rows = sparse_dummies(df, category_index(df, columns), columns, ["c_custkey"])
    return rows.select("c_custkey", "size", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def validation_split(spark, d):
    """H7: the stratified fifth that training holds back."""
    fit, held = models.validation_split(fx.fx_high(spark, d), "is_high", LK, 42)
    return fit.withColumn("part", F.lit("fit")).unionByName(held.withColumn("part", F.lit("validation"))).select(*LK, "is_high", "part")


def coerce_strict(spark, d):
    """Text features that are numbers throughout."""
    df = integrate(fx.fx_dirty(spark, d).drop("mixed_text", "rf_dirty"))
    out = coerce_numeric_strict(df, "Status", LK)
    return out.withColumn("qty_text", F.round("qty_text", 6))


QUERIES = {f.__name__: f for f in (row_continuity, split_written, fitted_apply, prep_full_log, candidate_seat, failure_report, stage_failures, evaluation_context,
                                    schema_summary, recommended_search, wide_categories, validation_split, coerce_strict)} | {"run_report": report_rows}
