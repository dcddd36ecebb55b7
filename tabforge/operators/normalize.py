"""Header, string and type normalisation.

All projections are single ``select``s; the only statistics pass is the one
aggregation that decides which text columns are numeric (B7/B8).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.constants import BLANK_HEADER_PATTERN, ID_LIKE_PATTERNS
from tabforge.errors import DataError
from tabforge.functions.exprs import (FLOAT_TYPES, clean_text, col, is_numeric_type,
                                      is_string_type, nan_to_null, parse_number)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim every column name; two names that trim to the same text is an error."""
    names = [c.strip() for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise DataError(f"Column names collide after trimming: {dupes}")
    return df.toDF(*names)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Every text column (target included): trim, lower, 'nan'/'none'/'' -> NULL.

    Float columns get NaN -> NULL so that every later statistic sees SQL NULL
    as the only missing marker.
    """
    out = []
    for f in df.schema.fields:
        if is_string_type(f.dataType):
            out.append(clean_text(col(f.name)).alias(f.name))
        elif isinstance(f.dataType, FLOAT_TYPES):
            out.append(nan_to_null(col(f.name)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def integrate(df: DataFrame) -> DataFrame:
    """normalize_headers + normalize_strings (what loading a table applies)."""
    return normalize_strings(normalize_headers(df))


def detect_id_like(columns: Iterable[str], target: str | None = None) -> list[str]:
    """Names that look like identifiers (regex search on trimmed lower-case names)."""
    out = []
    for c in columns:
        if c == target:
            continue
        n = c.strip().lower()
        if any(re.search(p, n) for p in ID_LIKE_PATTERNS) or re.search(BLANK_HEADER_PATTERN, n):
            out.append(c)
    return out


def id_like_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, id_like) for every column of the given tables.

    Metadata only: the schemas are read, no rows are scanned.
    """
    rows = []
    for t, df in tables.items():
        flagged = set(detect_id_like(df.columns))
        rows += [(t, c, c in flagged) for c in df.columns]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, id_like boolean")


def excluded_columns(df: DataFrame, target: str, manual: Sequence[str] = ()) -> list[str]:
    """Ordered union of manually dropped names and detected id-like names."""
    return list(dict.fromkeys(list(manual) + detect_id_like(df.columns, target)))


def drop_columns(df: DataFrame, columns: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    """Drop the named columns; unknown names and the target are ignored."""
    to_drop = [c for c in columns if c in df.columns and c != target]
    return (df.drop(*to_drop) if to_drop else df), to_drop


def target_last(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys first, then features in their order, then the target."""
    feats = [c for c in df.columns if c != target and c not in keys]
    return df.select(*[col(c) for c in list(keys) + feats + [target]])


def _text_parse_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(non-null count, parsable count) per text column in one aggregation."""
    if not columns:
        return {}
    exprs = []
    for i, c in enumerate(columns):
        exprs.append(F.count(col(c)).alias(f"n{i}"))
        exprs.append(F.count(parse_number(col(c))).alias(f"p{i}"))
    row = df.agg(*exprs).collect()[0]
    return {c: (row[f"n{i}"], row[f"p{i}"]) for i, c in enumerate(columns)}


def coerce_numeric(df: DataFrame, target: str, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Lenient: a text feature whose every non-null value parses becomes double.

    Columns where nothing parses stay text; columns that mix numbers and
    non-numbers raise, naming them.  All-null columns are left alone.
    """
    text_cols = [f.name for f in df.schema.fields
                 if f.name != target and f.name not in keys and not is_numeric_type(f.dataType)]
    stats = _text_parse_stats(df, text_cols)
    corrupt = [c for c, (n, p) in stats.items() if n > 0 and 0 < p < n]
    if corrupt:
        raise DataError(f"Mixed numeric and non-numeric values in columns {corrupt}.")
    convert = {c for c, (n, p) in stats.items() if n > 0 and p == n}
    out = [parse_number(col(c)).alias(c) if c in convert else col(c) for c in df.columns]
    return df.select(*out), sorted(convert)


def coerce_numeric_strict(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Strict: every feature must be numeric (text that fully parses is converted)."""
    text_cols = [f.name for f in df.schema.fields
                 if f.name != target and f.name not in keys and not is_numeric_type(f.dataType)]
    stats = _text_parse_stats(df, text_cols)
    corrupt = [c for c, (n, p) in stats.items() if n > 0 and p < n]
    if corrupt:
        raise DataError(f"Non-numeric values found in feature columns {corrupt}.")
    conv = set(text_cols)
    return df.select(*[parse_number(col(c)).alias(c) if c in conv else col(c) for c in df.columns])


def feature_columns(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in keys]


def as_double_features(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Numeric features cast to double (booleans become 0/1)."""
    feats = set(feature_columns(df, target, keys))
    return df.select(*[col(c).cast(T.DoubleType()).alias(c) if c in feats else col(c)
                       for c in df.columns])
