"""Split, train, evaluate, deploy and score stages (M2-M6).

Each stage takes DataFrames and returns DataFrames plus a small result
record; stage boundaries can be persisted as Parquet (``write_stage``), which
also cuts lineage so a lost executor only recomputes from the last stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import DEFAULT_SEED, MAX_CANDIDATES, MAX_CLASS_DRIFT, MIN_ROWS, VERDICTS
from tabforge.operators import candidates, checks, gate, metrics, models, profile, sampling
from tabforge.operators.score import score
from tabforge.session import cut_lineage
from tabforge.sources.runlog import RunLog
from tabforge.sources.tables import write_stage


# ------------------------------------------------------------------ M2 split
@dataclass
class SplitResult:
    train: DataFrame
    test: DataFrame
    drift: DataFrame
    info: dict = field(default_factory=dict)
    log: RunLog | None = None


def split_stage(df: DataFrame, target: str, keys: Sequence[str] = (), test_size: float | None = None,
                stratify: bool | None = None, seed: int = DEFAULT_SEED,
                max_drift: float = MAX_CLASS_DRIFT, log: RunLog | None = None, folder: str | None = None) -> SplitResult:
    """validate -> recommend -> split -> drift check (raises over the limit) -> write.

    With ``folder`` the sides are written there as ``train`` and ``test`` and the
    result reads them from there."""
    log = log or RunLog("split")
    checks.require(checks.quality_checks(df, target, keys=keys, min_rows=MIN_ROWS),
                   only=["non_empty", "min_rows", "binary_target", "numeric_features", "null_free_features"])
    rec = profile.split_recommendation(df, target).collect()[0]
    log.step("profile_split_data", {"target": target}, rec["rows"], rec["rows"])
    ts = rec["test_size"] if test_size is None else test_size
    st = rec["stratify"] if stratify is None else stratify
    hk = models.hash_keys(df, keys)
    sp = cut_lineage(sampling.split(df, target, hk, test_size=ts, stratify=st, seed=seed))
    drift = sampling.class_drift(sp, target, max_drift=max_drift)
    mx = sampling.require_drift_ok(drift)
    log.step("split_train_test", {"test_size": ts, "stratify": st, "seed": seed}, rec["rows"], rec["rows"])
    log.step("validate_split", {"max_class_drift": max_drift}, rec["rows"], rec["rows"], f"max drift {mx:.4f}")
    train = sp.where(F.col("split") == "train").drop("split")
    test = sp.where(F.col("split") == "test").drop("split")
    result = SplitResult(train, test, drift, {"test_size": ts, "stratify": st, "max_drift": mx, "rows": rec["rows"]}, log)
    if folder:
        counts = save_split(result, folder)
        result.train, result.test = (df.sparkSession.read.schema(side.schema).parquet(f"{folder}/{name}") for name, side in (("train", train), ("test", test)))
        log.step("finalize_split", {"folder": folder, **counts}, rec["rows"], sum(counts.values()))
    return result


def save_split(sp: SplitResult, path: str) -> dict[str, int]:
    """A4/M2: train and test tables below ``path``; their row counts must add up
    to what the split step logged (C5)."""
    counts = {name: write_stage(part, f"{path}/{name}") for name, part in (("train", sp.train), ("test", sp.test))}
    checks.require_row_count(sum(counts.values()), sp.info.get("rows"), "split")
    return counts


# ------------------------------------------------------------------ M3 train
@dataclass
class TrainResult:
    registry: models.CandidateRegistry
    best: models.Candidate
    recommendation: dict
    log: RunLog | None = None


def train_stage(train: DataFrame, target: str, keys: Sequence[str] = (), baseline=("logistic_regression",
                {"C": 1.0, "max_iter": 1000, "random_state": 42}),
                search=("random_forest", {"n_estimators": [20, 50], "max_depth": [5, 10]}),
                fixed=None, seed: int = DEFAULT_SEED, log: RunLog | None = None, folder: str | None = None) -> TrainResult:
    """validate -> recommend -> decision -> baseline -> grid search -> choose best.

    With ``folder`` every candidate becomes a row of the table ``candidates`` there,
    beside those of earlier runs; the limit on their number is checked before
    anything is fitted, and the seat is decided by the whole table."""
    log = log or RunLog("train")
    spark = train.sparkSession
    table = f"{folder}/candidates"

    def keep(c: models.Candidate) -> None:
        reg.add(c)
        if folder:
            c.extra["row"] = candidates.append_candidate(spark, table, c.algorithm, c.method, c.params, c.metrics)

    if folder:
        candidates.next_candidate(spark, table, MAX_CANDIDATES - bool(search))
    sides = models.training_sides(train, target, keys, seed)
    rec = profile.train_recommendation(train, target).collect()[0].asDict()
    log.decision("algorithm choice", [baseline[0], search[0] if search else "none"],
                 f"baseline {baseline[0]}" + (f", tune {search[0]}" if search else ""),
                 f"rows={rec['rows']}; rule suggests {rec['algorithm']} (tune={rec['tune']})")
    reg = models.CandidateRegistry()
    c = models.train_baseline(train, target, baseline[0], baseline[1], keys=keys, seed=seed, cand_id=reg.next_id(), sides=sides)
    keep(c)
    log.step("train_baseline", {"algorithm": c.algorithm}, rec["rows"], rec["rows"],
             f"val F1 {c.metrics['validation_f1_weighted']:.4f}")
    if search:
        t = models.tune(train, target, search[0], search[1], fixed=fixed or {"random_state": seed}, keys=keys,
                        seed=seed, cand_id=reg.next_id(), sides=sides)
        keep(t)
        log.step("tune_hyperparameters", {"algorithm": t.algorithm, "grid": search[1]}, rec["rows"], rec["rows"],
                 f"cv {t.metrics['best_cv_score']:.4f}, val F1 {t.metrics['validation_f1_weighted']:.4f}")
    best = reg.best()
    if folder:      # an earlier run's candidate may hold the seat; of this run's the best one is returned
        log.step("select_candidate", {"seat": candidates.promote_row(candidates.read_candidates(spark, table))["candidate_id"]}, None, None)
    log.step("finalize_training", {"best": best.id}, rec["rows"], rec["rows"])
    return TrainResult(reg, best, rec, log)


# --------------------------------------------------------------- M4 evaluate
@dataclass
class EvalResult:
    metrics: DataFrame
    confusion: DataFrame
    roc: DataFrame | None
    auc: float | None
    signals: DataFrame
    verdict: DataFrame
    log: RunLog | None = None


def predictions(c: models.Candidate, df: DataFrame) -> DataFrame:
    """Label text, predicted label text and P(class index 1) for a table."""
    from pyspark.ml.functions import vector_to_array
    from tabforge.operators.encode import label_index, label_inverse
    pred = c.model.transform(df.withColumn("label", label_index(F.col(c.target), c.classes)))
    return pred.select(F.col(c.target).cast("string").alias("actual"),
                       label_inverse(F.col("prediction"), c.classes).alias("predicted"),
                       vector_to_array("probability")[1].alias("score"))


def evaluate_stage(c: models.Candidate, train: DataFrame, test: DataFrame, verdict: str | None = None,
                   rationale: str | None = None, log: RunLog | None = None, bundle: str | None = None) -> EvalResult:
    """metrics x {train, test} -> confusion + ROC on test -> signals -> verdict.  Test
    metrics and verdict are added to the promoted model at ``bundle``."""
    log = log or RunLog("evaluate")
    ptr, pte = predictions(c, train), cut_lineage(predictions(c, test))
    m_tr = metrics.weighted_metrics(ptr, "actual", "predicted", c.classes)
    m_te = metrics.weighted_metrics(pte, "actual", "predicted", c.classes)
    mt = m_tr.withColumn("split", F.lit("train")).unionByName(m_te.withColumn("split", F.lit("test")))
    conf = metrics.confusion(pte, "actual", "predicted", c.classes)
    pos = c.classes[1]
    roc = metrics.roc_points(pte, "actual", "score", pos)
    auc = metrics.roc_auc(pte, "actual", "score", pos).collect()[0]["auc"]
    sig = gate.deploy_signals(m_tr, m_te, test, c.target, c.metrics.get("validation_f1_weighted"))
    sug = sig.collect()[0]["suggested_verdict"]
    v = verdict or sug
    rec = gate.record_verdict(sig, v, rationale or f"Threshold rule applied to test F1 and train-test gap: {sug}")
    log.step("issue_deploy_verdict", {"verdict": v}, None, None)
    if bundle:
        models.add_evaluation(test.sparkSession, bundle, {**m_te.first().asDict(), "auc": auc}, rec.first()["verdict"], rec.first()["rationale"])
    return EvalResult(mt, conf, roc, auc, sig, rec, log)


# ------------------------------------------------------------------ deploy
def deploy_stage(verdicts: DataFrame, rationale: str | None = None, remediation=None):
    """Branch on the verdict; the failure branch needs rationale + remediation steps."""
    br = gate.deploy_branch(verdicts)
    b = br.collect()[0]["branch"]
    if b == "do_not_deploy":
        return br, gate.failure_record(verdicts.sparkSession, rationale or verdicts.collect()[0]["rationale"],
                                       remediation)
    return br, None


def bundle_of(c: models.Candidate, schema: list[dict]) -> dict:
    return {"model": c.model, "features": c.features, "classes": c.classes, "target": c.target,
            "input_schema": schema, "algorithm": c.algorithm}


def promote(c: models.Candidate, path: str, schema: list[dict]) -> None:
    """Write the chosen candidate's model, classes, features and schema."""
    models.save_bundle(c, path, schema)


def score_promoted(raw: DataFrame, path: str) -> DataFrame:
    """M5: score a raw table with a bundle that ``promote`` wrote."""
    return score(raw, models.load_bundle(raw.sparkSession, path))


def score_stage(raw: DataFrame, c: models.Candidate, schema: list[dict]) -> DataFrame:
    """M5: score a raw table with the chosen candidate."""
    return score(raw, bundle_of(c, schema))


__all__ = ["split_stage", "train_stage", "evaluate_stage", "deploy_stage", "score_stage", "score_promoted", "promote", "save_split", "write_stage",
           "VERDICTS"]
