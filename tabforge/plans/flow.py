"""End to end (M6): prepare -> split -> train -> evaluate -> deploy -> score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabforge import fixtures as fx
from tabforge.fixtures import LINEITEM_KEYS
from tabforge.plans.prep import PrepResult, prepare
from tabforge.plans.stages import (EvalResult, SplitResult, TrainResult, deploy_stage, evaluate_stage,
                                   score_stage, split_stage, train_stage)


@dataclass
class FlowResult:
    prep: PrepResult
    split: SplitResult
    train: TrainResult
    evaluation: EvalResult
    branch: DataFrame
    remediation: DataFrame | None
    scored: DataFrame


def end_to_end(spark: SparkSession, sf_dir: str, balance: str = "none",
               search=("random_forest", {"n_estimators": [20], "max_depth": [5, 8]})) -> FlowResult:
    """The stages in fixed order on fx_high; the raw table is scored at the end."""
    raw = fx.fx_high(spark, sf_dir)
    prep = prepare(raw, "is_high", keys=LINEITEM_KEYS, balance=balance)
    sp = split_stage(prep.table, "is_high", keys=LINEITEM_KEYS)
    tr = train_stage(sp.train, "is_high", keys=LINEITEM_KEYS, search=search)
    ev = evaluate_stage(tr.best, sp.train, sp.test)
    branch, remediation = deploy_stage(ev.verdict)
    scored = score_stage(raw.drop("is_high"), tr.best, prep.schema)
    return FlowResult(prep, sp, tr, ev, branch, remediation, scored)
