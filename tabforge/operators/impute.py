"""Missing-value handling.

Statistics are taken over all rows (before null-target rows go), in one
pass per family: exact distributed medians, tall-count modes.  ``skip`` is a
true no-op and unknown strategies raise (the behaviour being reproduced
silently fell through to categorical-mode only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import IMPUTE_STRATEGIES
from tabforge.errors import ParamError
from tabforge.functions.exprs import col, is_numeric_type
from tabforge.operators import stats


def drop_rows_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_rows_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.max(col(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(columns)]).collect()[0]
    return [c for i, c in enumerate(columns) if row[f"n{i}"]]


def fit_fill_values(df: DataFrame, strategy: str, target: str, columns: Sequence[str] | None = None,
                    keys: Sequence[str] = ()) -> dict[str, object]:
    """Fill value per column that has nulls (median/mode for numeric, mode for text)."""
    cols = list(columns) if columns else [c for c in df.columns if c != target and c not in keys]
    cols = [c for c in cols if c in df.columns]
    nulls = columns_with_nulls(df, cols)
    num = [c for c in nulls if is_numeric_type(df.schema[c].dataType)]
    cat = [c for c in nulls if not is_numeric_type(df.schema[c].dataType)]
    fills: dict[str, object] = {}
    if strategy == "median":
        fills.update(stats.medians(df, num))
    elif strategy == "mode":
        m = stats.modes(df, num, numeric=True)
        fills.update({c: (0.0 if v is None else v) for c, v in m.items()})
    if strategy != "skip":
        m = stats.modes(df, cat, numeric=False)
        fills.update({c: ("unknown" if v is None else v) for c, v in m.items()})
    return fills


def apply_fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.name in fills and fills[f.name] is not None:
            out.append(F.coalesce(col(f.name), F.lit(fills[f.name]).cast(f.dataType)).alias(f.name)
                       if not (is_numeric_type(f.dataType) and _integral(f.dataType)) else
                       F.coalesce(col(f.name).cast("double"), F.lit(float(fills[f.name]))).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def _integral(dt) -> bool:
    from pyspark.sql import types as T
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def impute(df: DataFrame, strategy: str, target: str, columns: Sequence[str] | None = None,
           keys: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Impute or drop missing values, then drop rows whose target is null."""
    if strategy not in IMPUTE_STRATEGIES:
        raise ParamError(f"Unknown imputation strategy: {strategy}; use one of {IMPUTE_STRATEGIES}")
    if strategy == "skip":
        return df, {"strategy": "skip"}
    if strategy == "drop_rows":
        return drop_rows_any_null(df), {"strategy": strategy}
    if strategy == "knn":
        from tabforge.operators.knn_impute import knn_impute
        out, info = knn_impute(df, target, columns=columns, keys=keys)
        fills = fit_fill_values(out, "mode_categorical_only", target, columns, keys)
        out = apply_fill(out, {c: v for c, v in fills.items()
                               if not is_numeric_type(out.schema[c].dataType)})
        return drop_rows_null_target(out, target), info
    fills = fit_fill_values(df, strategy, target, columns, keys)
    return drop_rows_null_target(apply_fill(df, fills), target), {"strategy": strategy, "fills": fills}
