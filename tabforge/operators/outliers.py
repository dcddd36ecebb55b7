"""IQR outlier fences, removal and capping.

Fences are fitted once over the unfiltered table (exact distributed
quantiles) and applied as literals in one filter / one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import IQR_MULTIPLIER
from tabforge.errors import ParamError
from tabforge.functions.exprs import col, is_numeric_type
from tabforge.operators.stats import iqr_fences_stats


def outlier_columns(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                    keys: Sequence[str] = ()) -> list[str]:
    cand = columns if columns else df.columns
    return [c for c in cand if c in df.columns and c != target and c not in keys
            and is_numeric_type(df.schema[c].dataType)]


def fit_fences(df: DataFrame, target: str, columns: Sequence[str] | None = None,
               keys: Sequence[str] = (), k: float = IQR_MULTIPLIER) -> dict[str, dict]:
    return iqr_fences_stats(df, outlier_columns(df, target, columns, keys), k)


def fences_table(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                 keys: Sequence[str] = (), k: float = IQR_MULTIPLIER) -> DataFrame:
    """(column_name, q1, q3, iqr, lower, upper, applies) per numeric feature."""
    f = fit_fences(df, target, columns, keys, k)
    rows = [(c, v["q1"], v["q3"], v["iqr"], v["lower"], v["upper"], v["applies"]) for c, v in f.items()]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, q3 double, iqr double, lower double, upper double, applies boolean")


def _outside(c: str, f: dict):
    # a NULL value is never outside a fence
    return F.coalesce((col(c) < F.lit(f["lower"])) | (col(c) > F.lit(f["upper"])), F.lit(False))


def remove_outliers(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                    keys: Sequence[str] = (), fences: dict | None = None) -> DataFrame:
    """Drop rows outside any applicable fence; nulls are kept."""
    fences = fences if fences is not None else fit_fences(df, target, columns, keys)
    active = [(c, f) for c, f in fences.items() if f["applies"]]
    if not active:
        return df
    cond = F.lit(False)
    for c, f in active:
        cond = cond | _outside(c, f)
    return df.where(~cond)


def cap_outliers(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                 keys: Sequence[str] = (), fences: dict | None = None) -> DataFrame:
    """Clip values to the fences; row count unchanged."""
    fences = fences if fences is not None else fit_fences(df, target, columns, keys)
    out = []
    for c in df.columns:
        f = fences.get(c)
        if f and f["applies"]:
            lo, hi = F.lit(f["lower"]), F.lit(f["upper"])
            v = F.when(col(c) < lo, lo).when(col(c) > hi, hi).otherwise(col(c))
            out.append(v.cast(df.schema[c].dataType).alias(c) if not _is_integral(df, c) else
                       v.alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def _is_integral(df, c):
    from pyspark.sql import types as T
    return isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def capped_columns(df: DataFrame, fences: dict) -> list[str]:
    """Columns where capping changes at least one value (one aggregation)."""
    active = [(c, f) for c, f in fences.items() if f["applies"]]
    if not active:
        return []
    row = df.agg(*[F.max(_outside(c, f).cast("int")).alias(f"c{i}") for i, (c, f) in enumerate(active)]).collect()[0]
    return [c for i, (c, _) in enumerate(active) if row[f"c{i}"]]


def handle_outliers(df: DataFrame, strategy: str, target: str, columns: Sequence[str] | None = None,
                    keys: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Dispatch on iqr_remove / iqr_cap / skip; unknown strategies raise."""
    if strategy == "skip":
        return df, {"strategy": "skip", "columns_capped": []}
    if strategy not in ("iqr_remove", "iqr_cap"):
        raise ParamError(f"Unknown outlier strategy: {strategy}")
    fences = fit_fences(df, target, columns, keys)
    if strategy == "iqr_remove":
        return remove_outliers(df, target, fences=fences), {"strategy": strategy, "fences": fences}
    return (cap_outliers(df, target, fences=fences),
            {"strategy": strategy, "fences": fences, "columns_capped": capped_columns(df, fences)})
