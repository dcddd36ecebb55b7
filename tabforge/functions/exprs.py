"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.constants import MISSING_TOKENS

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)

# A numeric literal as a lenient parser accepts it: optional sign, digits with
# optional fraction (or a bare fraction), optional exponent, or inf/nan words.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"

_SPACES = " \t\n\x0b\f\r"                           # what \s stands for
_LINE_ENDS = "\x85\u2028\u2029"                     # a last one of these stays, the spaces before it go
_BEFORE_END = r"\s+(?=[\x85\u2028\u2029]\z)"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def trim_all(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (not just spaces)."""
    t = F.btrim(c, F.lit(_SPACES))
    # the pattern takes most of the time, so only texts that it can match go through it
    ends = functools.reduce(operator.or_, [t.endswith(e) for e in _LINE_ENDS])
    return F.when(ends, F.regexp_replace(t, _BEFORE_END, "")).otherwise(t)


def clean_text(c: Column) -> Column:
    """trim -> lower -> missing tokens become NULL."""
    v = F.lower(trim_all(c))
    return F.when(v.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(v)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def numeric_text_ok(c: Column) -> Column:
    """True when text parses as a number the way a lenient parser would."""
    return F.lower(c).rlike(NUMERIC_TEXT)


def parse_number(c: Column) -> Column:
    """Text -> double; NULL when the text is not a number (never throws).

    Spark's own cast accepts forms like '1d' or '1f'; the regex guard rejects
    them so only plain decimal / exponent / inf text is numeric.
    """
    return parse_trimmed(trim_all(c))


def parse_trimmed(c: Column) -> Column:
    """``parse_number`` of text that ``trim_all`` has been through."""
    t = F.lower(c)
    return (F.when(~t.rlike(NUMERIC_TEXT), F.lit(None).cast("double"))
            .when(t.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(t.isin("-inf", "-infinity"), F.lit(float("-inf")))
            .when(t.isin("nan", "+nan", "-nan"), F.lit(None).cast("double"))
            .otherwise(t.try_cast("double")))


def row_hash(seed: int, keys: Sequence[str]) -> Column:
    """md5 over 'seed|k1|k2|...'; nulls become '' so the hash is total."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_uniform(h: Column, offset: int = 0) -> Column:
    """Uniform [0,1) from 8 hex digits of an md5 string, starting at ``offset``."""
    return F.conv(F.substring(h, offset + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_int(h: Column, offset: int = 0) -> Column:
    """Non-negative integer from 8 hex digits of an md5 string."""
    return F.conv(F.substring(h, offset + 1, 8), 16, 10).cast("bigint")


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and not is_numeric_type(f.dataType)]
