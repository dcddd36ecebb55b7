"""Data-quality checks.

Checks are DataFrames of ``(check, column_name, n, ok)`` built from one
aggregation over the table; :func:`require` turns failed rows into errors.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import MIN_ROWS
from tabforge.errors import DataError
from tabforge.functions.exprs import col, is_numeric_type

CHECK_SCHEMA = "check string, column_name string, n bigint, ok boolean"


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_count) for every listed column, one aggregation."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, null_count bigint")
    agg = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns])
    return agg.unpivot([], list(columns), "column_name", "null_count")


def null_report(df: DataFrame, target: str | None = None, features_only: bool = True,
                keys: Sequence[str] = ()) -> DataFrame:
    """Columns that contain nulls with their counts."""
    cols = [c for c in df.columns if c not in keys and (not features_only or c != target)]
    return null_counts(df, cols).where(F.col("null_count") > 0)


def null_report_message(rows: list, hint: str) -> str:
    items = ", ".join(f"{r['column_name']}={r['null_count']}" for r in sorted(rows, key=lambda r: r["column_name"]))
    return f"Null values in features: {items}. {hint}"


def quality_checks(df: DataFrame, target: str, keys: Sequence[str] = (), min_rows: int = MIN_ROWS,
                   require_numeric: bool = True) -> DataFrame:
    """C2 binary target, C3 minimum rows, C4 numeric features, C6 target present,
    plus feature nulls, as rows of (check, column_name, n, ok)."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.createDataFrame([("target_present", target, 0, False)], CHECK_SCHEMA)
    feats = [c for c in df.columns if c != target and c not in keys]
    non_numeric = [c for c in feats if not is_numeric_type(df.schema[c].dataType)]
    agg = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(col(target)).alias("classes"),
        *([F.count_if(functools.reduce(operator.or_, [col(c).isNull() for c in feats])).alias("null_rows")]
          if feats else [F.lit(0).cast("bigint").alias("null_rows")]),
    )
    def row(name, column, n, ok):
        return F.struct(F.lit(name).alias("check"), F.lit(column).cast("string").alias("column_name")
                        if not hasattr(column, "alias") else column.cast("string").alias("column_name"),
                        n.cast("bigint").alias("n"), ok.alias("ok"))

    checks = F.array(
        row("non_empty", None, F.col("rows"), F.col("rows") > 0),
        row("target_present", target, F.lit(1), F.lit(True)),
        row("min_rows", None, F.col("rows"), F.col("rows") >= min_rows),
        row("binary_target", target, F.col("classes"), F.col("classes") == 2),
        row("has_features", None, F.lit(len(feats)), F.lit(len(feats) > 0)),
        row("numeric_features", ",".join(non_numeric) or None, F.lit(len(non_numeric)),
            F.lit(not non_numeric or not require_numeric)),
        row("null_free_features", None, F.col("null_rows"), F.col("null_rows") == 0),
    )
    return agg.select(F.inline(checks)).toDF("check", "column_name", "n", "ok")


def require(checks: DataFrame, only: Sequence[str] | None = None) -> None:
    """Raise DataError listing every failed check."""
    rows = checks.collect()
    bad = [r for r in rows if not r["ok"] and (only is None or r["check"] in only)]
    if bad:
        raise DataError("; ".join(f"{r['check']} failed ({r['column_name'] or ''}: {r['n']})" for r in bad))


def require_binary_target(df: DataFrame, target: str, classes: int | None = None) -> int:
    """``classes``: how many there are, where they have been counted already."""
    if target not in df.columns:
        raise DataError(f"Target '{target}' not in columns {df.columns}.")
    n = df.agg(F.count_distinct(col(target))).collect()[0][0] if classes is None else classes
    if n != 2:
        raise DataError(f"Binary classification requires exactly 2 classes, found {n}.")
    return n


def require_numeric_features(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    feats = [c for c in df.columns if c != target and c not in keys]
    if not feats:
        raise DataError("No feature columns.")
    bad = [c for c in feats if not is_numeric_type(df.schema[c].dataType)]
    if bad:
        raise DataError(f"All features must be numeric. Non-numeric: {bad}")
    return feats


def require_no_feature_nulls(df: DataFrame, target: str, keys: Sequence[str] = (), hint: str = "") -> None:
    rows = null_report(df, target, keys=keys).collect()
    if rows:
        raise DataError(null_report_message(rows, hint or "Impute missing values first."))


def require_columns(df: DataFrame, expected: Sequence[str], what: str = "features") -> None:
    """Every expected column is present (first five missing are named)."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise DataError(f"Missing {what}: {missing[:5]}" + (" ..." if len(missing) > 5 else ""))


def require_row_count(actual: int, expected: int | None, where: str) -> None:
    """Row-count continuity against the last logged step."""
    if expected is not None and actual != expected:
        raise DataError(f"{where}: table has {actual} rows but the last step produced {expected}.")
