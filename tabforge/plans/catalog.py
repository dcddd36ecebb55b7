"""Registered queries: one per operator family, each over whole driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame.  Float
outputs are rounded to 6 dp so they can be compared with the DuckDB oracle
(same rounding there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge import fixtures as fx
from tabforge.fixtures import LINEITEM_KEYS as LK
from tabforge.operators import checks, gate, metrics, models, normalize, outliers, profile, sampling, select
from tabforge.operators import score as score_mod
from tabforge.operators.score import score_linear
from tabforge.operators.encode import (build_input_schema, encode_features, label_classes, one_hot,
                                      transform_raw)
from tabforge.operators.impute import drop_rows_any_null, impute

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def r6(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Round float columns to 6 dp (or the per-column override)."""
    digits = digits or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c.cast("double"), digits.get(f.name, 6)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# ------------------------------------------------------------------ step 1
def q_normalize_strings(spark, d):
    return normalize.integrate(fx.fx_dirty(spark, d))


def q_coerce_numeric(spark, d):
    df = normalize.integrate(fx.fx_dirty(spark, d).drop("mixed_text"))
    out, _ = normalize.coerce_numeric(df, "Status", keys=LK)
    return r6(out)


def q_null_report(spark, d):
    return checks.null_report(fx.fx_nulls(spark, d), "l_linestatus", features_only=False, keys=LK)


def q_id_like_columns(spark, d):
    return normalize.id_like_report({t: fx.table(spark, d, t) for t in TABLES})


def q_quality_checks(spark, d):
    return checks.quality_checks(fx.fx_high(spark, d), "is_high", keys=LK)


# ------------------------------------------------------------------ step 2
def q_profile_columns(spark, d):
    df = normalize.integrate(fx.fx_nulls(spark, d))
    # means of 2-decimal data over 60,000 rows tie exactly at 6 dp, never at 7
    return r6(profile.profile_columns(df, "l_linestatus", keys=LK), {"mean": 7})


def q_top_values(spark, d):
    df = normalize.integrate(fx.fx_nulls(spark, d))
    return profile.top_values(df, "l_linestatus", keys=LK)


def q_class_balance(spark, d):
    return profile.class_balance(normalize.integrate(fx.fx_imbalanced(spark, d)), "quality")


def q_iqr_fences(spark, d):
    return r6(outliers.fences_table(fx.fx_high(spark, d), "is_high", keys=LK))


def q_prep_recommendations(spark, d):
    df = normalize.integrate(fx.fx_imbalanced(spark, d))
    return profile.prep_recommendations(df, "quality", keys=["doc_id"])


# ------------------------------------------------------------------ step 3
def _events(spark, d):
    return normalize.integrate(fx.fx_outliers(spark, d))


def q_outliers_remove(spark, d):
    return r6(outliers.remove_outliers(_events(spark, d), "is_error", keys=["event_id"]))


def q_outliers_cap(spark, d):
    return r6(outliers.cap_outliers(_events(spark, d), "is_error", keys=["event_id"]))


def q_impute_median(spark, d):
    out, _ = impute(normalize.integrate(fx.fx_nulls(spark, d)), "median", "l_linestatus", keys=LK)
    return r6(out)


def q_impute_mode(spark, d):
    out, _ = impute(normalize.integrate(fx.fx_nulls(spark, d)), "mode", "l_linestatus", keys=LK)
    return r6(out)


def q_drop_null_rows(spark, d):
    return r6(drop_rows_any_null(normalize.integrate(fx.fx_nulls(spark, d))))


# ------------------------------------------------------------------ step 4
def _redundant(spark, d):
    return normalize.integrate(fx.fx_redundant(spark, d))


def q_one_hot_drop_first(spark, d):
    out, _ = one_hot(_redundant(spark, d), "is_big", "one_hot_drop_first", keys=LK)
    return r6(out)


def q_one_hot_full(spark, d):
    out, _ = one_hot(_redundant(spark, d), "is_big", "one_hot_full", keys=LK)
    return r6(out)


def q_input_schema(spark, d):
    enc, info = encode_features(_redundant(spark, d), "one_hot_drop_first", "is_big", keys=LK)
    feats = [c for c in enc.columns if c != "is_big" and c not in LK]
    sch = build_input_schema(info["pre_encode"], info["groups"], feats, info["excluded"], LK)
    rows = [(i, s["name"], s["type"], ",".join(s["categories"]) if s["categories"] else None,
             s["drop_first"], ",".join(s["dummy_columns"]) if s["dummy_columns"] else None)
            for i, s in enumerate(sch)]
    return spark.createDataFrame(rows, "pos int, name string, type string, categories string, "
                                       "drop_first boolean, dummy_columns string")


def q_label_index(spark, d):
    df = normalize.integrate(fx.fx_three_class(spark, d))
    classes = label_classes(df, "o_orderstatus")
    return spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "target_class string, label_index int")


def q_corr_matrix(spark, d):
    return r6(select.corr_table(_redundant(spark, d).drop("l_returnflag", "l_linestatus"), "is_big", keys=LK))


def q_target_corr(spark, d):
    return r6(select.target_corr_table(_redundant(spark, d).drop("l_returnflag", "l_linestatus"),
                                       "is_big", keys=LK))


def q_select_features(spark, d):
    enc, _ = encode_features(normalize.integrate(fx.fx_high(spark, d)), "one_hot_drop_first", "is_high", keys=LK)
    out, _ = select.filter_by_correlation(enc, "both", "is_high", keys=LK)
    return r6(out)


def q_prep_flow(spark, d):
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none")
    return r6(res.table)


# ------------------------------------------------------------------ step 5
def _high(spark, d):
    return normalize.integrate(fx.fx_high(spark, d))


def q_undersample(spark, d):
    df = normalize.integrate(fx.fx_imbalanced(spark, d))
    return sampling.undersample(df, "quality", keys=["doc_id"])


def q_split_random(spark, d):
    return r6(sampling.split(_high(spark, d), "is_high", LK, test_size=0.2, stratify=False))


def q_split_stratified(spark, d):
    return r6(sampling.split(_high(spark, d), "is_high", LK, test_size=0.3, stratify=True))


def q_kfold_assign(spark, d):
    return r6(sampling.kfold(_high(spark, d), "is_high", LK, k=5))


def q_class_drift(spark, d):
    sp = sampling.split(_high(spark, d), "is_high", LK, test_size=0.3, stratify=True)
    return sampling.class_drift(sp, "is_high")


def q_split_recommendation(spark, d):
    return profile.split_recommendation(_high(spark, d), "is_high")


# ------------------------------------------------------------------ step 6
def _rule(spark, d):
    return fx.fx_rule_scores(spark, d)


def q_confusion_matrix(spark, d):
    return metrics.confusion(_rule(spark, d), "l_linestatus", "prediction")


def q_weighted_metrics(spark, d):
    return r6(metrics.weighted_metrics(_rule(spark, d), "l_linestatus", "prediction"))


def q_classification_report(spark, d):
    return r6(metrics.classification_report(_rule(spark, d), "l_linestatus", "prediction"))


def q_roc_points(spark, d):
    return r6(metrics.roc_points(_rule(spark, d), "l_linestatus", "score", positive="O"))


def q_roc_auc(spark, d):
    return r6(metrics.roc_auc(_rule(spark, d), "l_linestatus", "score", positive="O"))


# ------------------------------------------------------------------ step 7
LINEAR_WEIGHTS = [0.02, 0.00001, -1.0, 2.0, 0.3, -0.2, 0.1]
LINEAR_INTERCEPT = -1.2


def _raw_schema(spark, d):
    """Feature schema fitted on fx_lineitem (target l_linestatus), all features kept."""
    enc, info = encode_features(normalize.integrate(fx.fx_lineitem(spark, d)), "one_hot_drop_first",
                                "l_linestatus", keys=LK)
    feats = [c for c in enc.columns if c != "l_linestatus" and c not in LK]
    sch = build_input_schema(info["pre_encode"], info["groups"], feats, info["excluded"], LK)
    classes = label_classes(normalize.integrate(fx.fx_lineitem(spark, d)), "l_linestatus")
    return sch, feats, classes


def q_transform_raw(spark, d):
    sch, feats, _ = _raw_schema(spark, d)
    return r6(transform_raw(fx.fx_raw_new(spark, d), sch, feats, passthrough=LK))


def _linear_scored(spark, d, raw=None):
    sch, feats, classes = _raw_schema(spark, d)
    raw = fx.fx_raw_new(spark, d) if raw is None else raw
    return score_linear(raw, sch, feats, LINEAR_WEIGHTS, LINEAR_INTERCEPT, classes)


def q_score_linear(spark, d):
    return r6(_linear_scored(spark, d))


def q_low_confidence(spark, d):
    return score_mod.low_confidence_count(_linear_scored(spark, d))


def q_class_probabilities(spark, d):
    _, _, classes = _raw_schema(spark, d)
    return r6(score_mod.class_probabilities(_linear_scored(spark, d), LK, classes))


# ------------------------------------------------------------------ step 9
def _prepared_split(spark, d):
    from tabforge.plans.prep import prepare
    from tabforge.plans.stages import split_stage
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none")
    sp = split_stage(res.table, "is_high", keys=LK)
    return res, sp


def _cand_frame(spark, cands):
    reg = models.CandidateRegistry()
    for c in cands:
        reg.add(c)
    return r6(reg.frame(spark))


def q_train_lr(spark, d):
    _, sp = _prepared_split(spark, d)
    c = models.train_baseline(sp.train, "is_high", "logistic_regression",
                              {"C": 1.0, "solver": "lbfgs", "max_iter": 1000, "random_state": 42}, keys=LK)
    return _cand_frame(spark, [c])


def q_train_rf(spark, d):
    _, sp = _prepared_split(spark, d)
    c = models.train_baseline(sp.train, "is_high", "random_forest",
                              {"n_estimators": 50, "max_depth": 10, "random_state": 42}, keys=LK)
    return _cand_frame(spark, [c])


def q_train_gbt(spark, d):
    _, sp = _prepared_split(spark, d)
    c = models.train_baseline(sp.train, "is_high", "gradient_boosting",
                              {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1, "random_state": 42},
                              keys=LK)
    return _cand_frame(spark, [c])


def q_grid_search(spark, d):
    _, sp = _prepared_split(spark, d)
    c = models.tune(sp.train, "is_high", "random_forest", {"n_estimators": [20, 50], "max_depth": [5, 10]},
                    fixed={"random_state": 42}, keys=LK)
    rows = [(i, str(pt), sc) for i, (pt, sc) in enumerate(zip(c.extra["grid"], c.extra["cv_scores"]))]
    return r6(spark.createDataFrame(rows, "grid_index int, params string, cv_f1_weighted double"))


def q_best_candidate(spark, d):
    from tabforge.plans.stages import train_stage
    _, sp = _prepared_split(spark, d)
    tr = train_stage(sp.train, "is_high", keys=LK)
    return r6(tr.registry.frame(spark))


def q_train_recommendation(spark, d):
    return profile.train_recommendation(_high(spark, d), "is_high")


# ----------------------------------------------------------------- step 10
def _rule_split(spark, d):
    return sampling.split(_rule(spark, d), "l_linestatus", LK, test_size=0.3, stratify=True)


def _rule_signals(spark, d):
    sp = _rule_split(spark, d)
    tr = sp.where("split = 'train'")
    te = sp.where("split = 'test'")
    m_tr = metrics.weighted_metrics(tr, "l_linestatus", "prediction")
    m_te = metrics.weighted_metrics(te, "l_linestatus", "prediction")
    return gate.deploy_signals(m_tr, m_te, te, "l_linestatus")


def q_deploy_signals(spark, d):
    return r6(_rule_signals(spark, d))


def q_deploy_branch(spark, d):
    sig = _rule_signals(spark, d)
    rec = gate.record_verdict(sig, " deploy ", "Reviewer accepts the rule scorer despite the low F1.")
    return r6(gate.deploy_branch(rec))


def q_run_log(spark, d):
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none", count_steps=True)
    return res.log.steps_frame(spark).select("seq", "tool", "rows_before", "rows_after")


def q_stage_validation(spark, d):
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none")
    return checks.quality_checks(res.table, "is_high", keys=LK)


# ----------------------------------------------------------------- step 11
def q_end_to_end(spark, d):
    from tabforge.plans.flow import end_to_end
    return r6(end_to_end(spark, d).scored)


def q_stream_score_equals_batch(spark, d):
    from tabforge.streaming.score_stream import score_stream_once
    sch, feats, classes = _raw_schema(spark, d)

    def scorer(stream_df):
        return score_linear(stream_df, sch, feats, LINEAR_WEIGHTS, LINEAR_INTERCEPT, classes)
    return r6(score_stream_once(spark, f"{d}/lineitem.parquet", fx.raw_new_projection, scorer))


# ------------------------------------------------------------------ step 8
def q_smote_rows(spark, d):
    """SMOTE on the prepared fx_high table (continuous features): synthetic rows only."""
    from tabforge.operators.resample import balance_classes
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none")
    out, _ = balance_classes(res.table, "smote", "is_high", keys=LK)
    return r6(out.where(F.col("l_orderkey").isNull()))


def q_smotenc_class_counts(spark, d):
    """SMOTE-NC (one-hot 0/1 columns present) on fx_imbalanced: class counts after balancing."""
    from tabforge.operators.resample import balance_classes
    enc, _ = encode_features(normalize.integrate(fx.fx_imbalanced(spark, d)), "one_hot_drop_first",
                             "quality", keys=["doc_id"])
    out, info = balance_classes(enc, "smote", "quality", keys=["doc_id"])
    return out.groupBy("quality").agg(F.count("*").alias("n")).withColumn(
        "method_applied", F.lit(info["method_applied"]))


def q_knn_impute(spark, d):
    out, _ = impute(normalize.integrate(fx.fx_knn(spark, d)), "knn", "l_linestatus", keys=LK)
    return r6(out)


def q_prep_flow_balanced(spark, d):
    """M1 with the profile's suggested balancing (SMOTE-NC / SMOTE)."""
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="suggested")
    return r6(res.table)


# ------------------------------------------------------- tables between stages
def _out(spark, name):
    from tabforge.session import work_path
    return work_path(spark, name)


def q_csv_load(spark, d):
    """fx_nulls written as CSV with a missing token, read back and typed."""
    from tabforge.sources.tables import load_table
    path = _out(spark, "fx_nulls.csv")
    fx.fx_nulls(spark, d).write.option("header", True).option("nullValue", "NA").csv(path)
    return r6(load_table(spark, path))


def q_stage_roundtrip(spark, d):
    from tabforge.sources.tables import read_stage, write_stage
    path = _out(spark, "fx_high")
    write_stage(fx.fx_high(spark, d), path, partition_by=["is_high"])
    return r6(read_stage(spark, path, "is_high", LK))


def q_schema_roundtrip(spark, d):
    from tabforge.sources.tables import read_schema, write_schema
    enc, info = encode_features(_redundant(spark, d), "one_hot_drop_first", "is_big", keys=LK)
    feats = [c for c in enc.columns if c != "is_big" and c not in LK]
    path = _out(spark, "schema")
    write_schema(spark, build_input_schema(info["pre_encode"], info["groups"], feats, info["excluded"], LK), path)
    rows = [(i, s["name"], s["type"], ",".join(s["categories"]) if s["categories"] else None,
             s["drop_first"], ",".join(s["dummy_columns"]) if s["dummy_columns"] else None)
            for i, s in enumerate(read_schema(spark, path))]
    return spark.createDataFrame(rows, "pos int, name string, type string, categories string, "
                                       "drop_first boolean, dummy_columns string")


def q_bundle_score(spark, d):
    """A promoted bundle, loaded and used, scores every row like the model in memory."""
    from tabforge.plans.stages import promote, score_promoted, score_stage
    res, sp = _prepared_split(spark, d)
    c = models.train_baseline(sp.train, "is_high", "logistic_regression", {"C": 1.0, "max_iter": 50}, keys=LK)
    path = _out(spark, "bundle")
    promote(c, path, res.schema)
    raw = fx.fx_high(spark, d).drop("is_high")
    now = score_stage(raw, c, res.schema).select(*LK, F.col("p_positive").alias("p"), F.col("prediction").alias("y"))
    both = score_promoted(raw, path).join(now, LK)
    same = (F.abs(F.col("p_positive") - F.col("p")) < 1e-12) & (F.col("prediction") == F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("different"))


def q_roc_auc_skewed(spark, d):
    """AUC over scores that pile up near 0 and 1."""
    s = F.col("score")
    piled = _rule(spark, d).withColumn("score", F.when(s < 0.5, s * 1e-9).otherwise(1 - s * 1e-9))
    return r6(metrics.roc_auc(piled, "l_linestatus", "score", positive="O"))


def q_iqr_fences_extreme(spark, d):
    """Quartiles of a column with infinities and of one over many magnitudes."""
    from tabforge.operators.stats import exact_quantiles
    price, key = F.col("l_extendedprice"), F.col("l_orderkey")
    df = fx.fx_high(spark, d).select(
        F.when(key % 50 == 0, F.lit(float("inf"))).when(key % 77 == 0, F.lit(float("-inf"))).otherwise(price).alias("with_inf"),
        F.when(key % 3 == 0, price * 1e6).when(key % 3 == 1, price).otherwise(F.col("l_quantity") / 1024).alias("wide"))
    got = exact_quantiles(df, ["with_inf", "wide"], [0.25, 0.5, 0.75])
    return r6(spark.createDataFrame([(c, *q) for c, q in got.items()], "column_name string, q1 double, median double, q3 double"))


def q_split_balanced(spark, d):
    """Rows per side and class after balancing and a stratified split."""
    from tabforge.operators.resample import balance_classes
    from tabforge.plans.prep import prepare
    table = prepare(fx.fx_high(spark, d), "is_high", keys=LK, balance="none").table
    balanced, _ = balance_classes(table, "smote", "is_high", keys=LK)
    side = sampling.split(balanced, "is_high", LK, test_size=0.2, stratify=True)
    return side.groupBy("split", F.col("is_high").cast("int").alias("is_high")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "csv_load": q_csv_load,
    "stage_roundtrip": q_stage_roundtrip,
    "schema_roundtrip": q_schema_roundtrip,
    "bundle_score": q_bundle_score,
    "roc_auc_skewed": q_roc_auc_skewed,
    "iqr_fences_extreme": q_iqr_fences_extreme,
    "split_balanced": q_split_balanced,
    "normalize_strings": q_normalize_strings,
    "coerce_numeric": q_coerce_numeric,
    "null_report": q_null_report,
    "id_like_columns": q_id_like_columns,
    "quality_checks": q_quality_checks,
    "profile_columns": q_profile_columns,
    "top_values": q_top_values,
    "class_balance": q_class_balance,
    "iqr_fences": q_iqr_fences,
    "prep_recommendations": q_prep_recommendations,
    "outliers_remove": q_outliers_remove,
    "outliers_cap": q_outliers_cap,
    "impute_median": q_impute_median,
    "impute_mode": q_impute_mode,
    "drop_null_rows": q_drop_null_rows,
    "one_hot_drop_first": q_one_hot_drop_first,
    "one_hot_full": q_one_hot_full,
    "input_schema": q_input_schema,
    "label_index": q_label_index,
    "corr_matrix": q_corr_matrix,
    "target_corr": q_target_corr,
    "select_features": q_select_features,
    "prep_flow": q_prep_flow,
    "undersample": q_undersample,
    "split_random": q_split_random,
    "split_stratified": q_split_stratified,
    "kfold_assign": q_kfold_assign,
    "class_drift": q_class_drift,
    "split_recommendation": q_split_recommendation,
    "confusion_matrix": q_confusion_matrix,
    "weighted_metrics": q_weighted_metrics,
    "classification_report": q_classification_report,
    "roc_points": q_roc_points,
    "roc_auc": q_roc_auc,
    "transform_raw": q_transform_raw,
    "score_linear": q_score_linear,
    "low_confidence": q_low_confidence,
    "class_probabilities": q_class_probabilities,
    "train_lr": q_train_lr,
    "train_rf": q_train_rf,
    "train_gbt": q_train_gbt,
    "grid_search": q_grid_search,
    "best_candidate": q_best_candidate,
    "train_recommendation": q_train_recommendation,
    "deploy_signals": q_deploy_signals,
    "deploy_branch": q_deploy_branch,
    "run_log": q_run_log,
    "stage_validation": q_stage_validation,
    "end_to_end": q_end_to_end,
    "stream_score_equals_batch": q_stream_score_equals_batch,
    "smote_rows": q_smote_rows,
    "smotenc_class_counts": q_smotenc_class_counts,
    "knn_impute": q_knn_impute,
    "prep_flow_balanced": q_prep_flow_balanced,
}
