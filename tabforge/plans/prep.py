"""Preparation stage (M1): raw table -> cleaned numeric table + feature schema.

normalise -> drop id-like / manual columns -> outliers -> impute -> encode ->
correlation filter -> balance -> finalize checks.  Every step is a lazy
DataFrame transformation; actions happen only where a step must *fit*
statistics.  The run log records rows before/after per step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tabforge.constants import IMBALANCE_RATIO, MIN_ROWS
from tabforge.errors import DataError
from tabforge.operators import checks
from tabforge.operators.encode import build_input_schema, encode_features
from tabforge.operators.impute import impute
from tabforge.operators.normalize import (coerce_numeric_strict, drop_columns, excluded_columns,
                                          integrate, target_last)
from tabforge.operators.outliers import handle_outliers
from tabforge.operators.select import filter_by_correlation
from tabforge.session import cut_lineage
from tabforge.sources.runlog import RunLog
from tabforge.sources.tables import continuity_check, logged_write, write_schema


@dataclass
class PrepResult:
    table: DataFrame
    schema: list[dict]
    target: str
    keys: list[str]
    features: list[str]
    info: dict = field(default_factory=dict)
    log: RunLog | None = None


def prepare(df: DataFrame, target: str, keys: Sequence[str] = (), manual_drops: Sequence[str] = (),
            outliers: str = "iqr_remove", imputation: str = "median",
            encoding: str = "one_hot_drop_first", correlation: str = "both",
            balance: str = "none", ratio: float = IMBALANCE_RATIO, seed: int = 42,
            log: RunLog | None = None, count_steps: bool = False, checkpoint: bool = True, folder: str | None = None) -> PrepResult:
    """Run the preparation stage; ``balance='suggested'`` uses the profile rule.

    With ``folder`` the table is written there before it is encoded (``working``),
    after selection and balancing (``selected``) and at the end (``cleaned``).  The
    log gets the rows that were written, counted on the way, and each table
    must still have them when the next step reads it (C5).  ``count_steps`` counts
    after every step instead, which takes a scan for each.

    The finished table is checkpointed into the shared checkpoint folder, so
    later stages (many actions each) start from it instead of replaying the
    preparation lineage, and a lost executor recomputes from there.
    """
    log = log or RunLog("prep")
    keys = list(keys)
    df = integrate(df)
    if target not in df.columns:
        raise DataError(f"Target '{target}' not in columns {df.columns}.")
    # the fits scan the normalised table ~15 times; it is kept (spilling to disk
    # where it does not fit) until the prepared table is checkpointed
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _steps(df, target, keys, manual_drops, outliers, imputation, encoding, correlation, balance, ratio, seed,
                      log, count_steps, checkpoint, folder)
    finally:
        df.unpersist()


def _steps(df: DataFrame, target: str, keys: list[str], manual_drops: Sequence[str], outliers: str, imputation: str,
           encoding: str, correlation: str, balance: str, ratio: float, seed: int, log: RunLog, count_steps: bool,
           checkpoint: bool, folder: str | None) -> PrepResult:
    info: dict = {}
    spark = df.sparkSession

    def stored(name, table, tool, params, before):
        """The table as it is read back, and its rows, once the log agrees with them."""
        path = f"{folder}/{name}"
        rows = logged_write(table, path, log, tool, params, before)
        checks.require(continuity_check(spark, path, log.steps_frame(spark), [tool]))
        return spark.read.schema(table.schema).parquet(path), rows

    def step(name, params, before, after_df):
        n_after = after_df.count() if count_steps else None
        log.step(name, params, before, n_after)
        return n_after

    n0 = df.count() if count_steps else None
    log.step("load", {"target": target}, n0, n0)

    df, dropped = drop_columns(df, list(manual_drops), target)
    n = step("drop_columns", {"columns": dropped}, n0, df)

    df, oinfo = handle_outliers(df, outliers, target, keys=keys)
    info["outliers"] = oinfo
    n = step("handle_outliers", {"strategy": outliers}, n, df)

    df, iinfo = impute(df, imputation, target, keys=keys)
    info["impute"] = iinfo
    if folder:
        df, n = stored("working", df, "impute_missing", {"strategy": imputation}, n)
    else:
        n = step("impute_missing", {"strategy": imputation}, n, df)

    encoded, einfo = encode_features(df, encoding, target, keys=keys, manual_drops=dropped)
    info["encode"] = {k: v for k, v in einfo.items() if k != "pre_encode"}
    n = step("encode_features", {"strategy": encoding}, n, encoded)

    selected, sinfo = filter_by_correlation(encoded, correlation, target, keys=keys)
    info["select"] = sinfo
    if folder and balance == "none":
        selected, n = stored("selected", selected, "filter_by_correlation", {"mode": correlation}, n)
    else:
        n = step("filter_by_correlation", {"mode": correlation}, n, selected)

    if balance != "none":
        from tabforge.operators.resample import balance_classes
        method = balance
        if balance == "suggested":
            from tabforge.operators.profile import prep_recommendations
            method = prep_recommendations(einfo["pre_encode"], target, keys=keys, ratio=ratio) \
                .collect()[0]["suggested_balance"]
        selected, binfo = balance_classes(selected, method, target, keys=keys, ratio=ratio, seed=seed)
        info["balance"] = binfo
        if folder:
            selected, n = stored("selected", selected, "balance_classes", {"method": method}, n)
        else:
            n = step("balance_classes", {"method": method}, n, selected)

    final, schema, feats = finalize(selected, target, keys, einfo, None if folder else log)
    if folder:
        final, n = stored("cleaned", final, "finalize_preparation", {"target": target}, n)
        write_schema(spark, schema, f"{folder}/schema")
    elif checkpoint:
        final = cut_lineage(final)
    info["features"] = feats
    return PrepResult(final, schema, target, keys, feats, info, log)


def finalize(df: DataFrame, target: str, keys: Sequence[str], einfo: dict,
             log: RunLog | None = None, min_rows: int = MIN_ROWS) -> tuple[DataFrame, list[dict], list[str]]:
    """C10 exclusion + feature checks, min rows, binary target, schema, strict numeric."""
    exclude = excluded_columns(einfo["pre_encode"], target, einfo.get("excluded", ()))
    df = df.drop(*[c for c in exclude if c in df.columns and c not in keys])
    feats = [c for c in df.columns if c != target and c not in keys]
    if not feats:
        raise DataError("No feature columns available for finalize.")
    agg = checks.quality_checks(df, target, keys=keys, min_rows=min_rows)
    checks.require(agg, only=["min_rows", "binary_target", "null_free_features"])
    schema = build_input_schema(einfo["pre_encode"], einfo["groups"], feats, exclude, keys)
    df = coerce_numeric_strict(df, target, keys)
    df = target_last(df, target, keys)
    if log is not None:
        log.step("finalize_preparation", {"target": target}, None, None)
    return df, schema, feats
