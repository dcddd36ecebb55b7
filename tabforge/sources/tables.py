"""Reading and writing the tables between stages.

Input is CSV or Parquet by suffix.  CSV is read as text and typed by one
aggregation over all rows: a column is boolean, integer or double when every
value that is not a missing token reads so, text otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col, parse_trimmed, trim_all
from tabforge.operators.encode import schema_frame, schema_from_frame
from tabforge.sources.runlog import RunLog

# FIXED VALUES: text that a CSV field holds for a missing value
CSV_MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_INTEGER = r"^[+-]?\d{1,18}$"
_DIGITS = r"\A[+-]?\d{1,18}\z"       # an integer that is a number for certain
_BOOLEAN, _WHOLE, _NUMBER = 1, 2, 4


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; missing tokens are NULL, columns typed by their
    values.  A column whose header is blank is called ``_cN``."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, nullValue="")
    if not raw.columns:
        raise DataError(f"{path} has no columns.")
    text = raw.select(*[F.when(~col(c).isin(*CSV_MISSING), col(c)).alias(c) for c in raw.columns])
    # a row per value, so that the code does not grow with the columns; bits of what a value reads as, shared by all of a column
    v = F.col("v")
    reads = (F.when(v.isin("True", "False", "TRUE", "FALSE", "true", "false"), _BOOLEAN).when(v.rlike(_DIGITS), _WHOLE | _NUMBER)
             .otherwise(F.when(v.rlike(_INTEGER), _WHOLE).otherwise(0) + F.when(parse_trimmed(v).isNotNull(), _NUMBER).otherwise(0)))
    places = [str(i) for i in range(len(raw.columns))]
    tall = text.select(*[trim_all(col(c)).alias(i) for i, c in zip(places, raw.columns)]).unpivot([], places, "i", "v")
    found = {int(r.i): r for r in tall.groupBy("i").agg(F.count("v").alias("n"), F.bit_and(F.when(F.col("v").isNotNull(), reads)).alias("bits")).collect()}
    if not found:
        raise DataError(f"{path} has no rows.")
    out = []
    for i, c in enumerate(raw.columns):
        n, bits, v = found[i].n, found[i].bits, trim_all(col(c))
        typed = (v.cast("boolean") if n and bits & _BOOLEAN else v.cast("bigint") if n and bits & _WHOLE
                 else parse_trimmed(v) if not n or bits & _NUMBER else col(c))
        out.append(typed.alias(c))
    return text.select(*out)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A1: a CSV or Parquet table; other suffixes, missing or empty tables raise."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    try:
        if suffix == "csv":
            return read_csv(spark, path)
        if suffix == "parquet":
            df = spark.read.parquet(path)
            if df.isEmpty():
                raise DataError(f"{path} has no rows.")
            return df
    except AnalysisException as e:
        raise DataError(f"{path} cannot be read: {e.getCondition()}") from e
    raise ParamError(f"{path}: only .csv and .parquet tables are read.")


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows: int | None = None) -> int:
    """A3/A4: write Parquet and compare what was written with what is there, and
    with ``rows``, the count of the step before, where it is given.  The rows are
    counted while they are written (an observed metric) and in the files' footers:
    ``df`` is computed once."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    there, sent = df.sparkSession.read.parquet(path).count(), seen.get["rows"]
    if there != sent or rows is not None and rows != sent:
        raise DataError(f"{path}: {sent if rows is None else rows} rows to write, {sent} written, {there} read back.")
    return there


def logged_write(df: DataFrame, path: str, log: RunLog, tool: str, params: dict, rows_before: int | None = None,
                 summary: str = "") -> int:
    """Write a step's table and log the step with the rows that were written."""
    rows = write_stage(df, path)
    log.step(tool, {**params, "path": path}, rows_before, rows, summary)
    return rows


def continuity_check(spark: SparkSession, path: str, steps: DataFrame, tools: Sequence[str]) -> DataFrame:
    """C5 as a check row: the table at ``path`` has the rows that the last of the
    ``tools`` in the log left (``n`` is how many it has).  A step without a row
    count doesn't count; without any such step the check holds."""
    last = steps.where(F.col("tool").isin(*tools) & F.col("rows_after").isNotNull()).agg(
        F.max_by("rows_after", "seq").alias("want"), F.max_by("tool", "seq").alias("tool"))
    there = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    return there.join(last).select(F.lit("row_count").alias("check"), F.col("tool").alias("column_name"), "n",
                                   F.coalesce(F.col("n") == F.col("want"), F.lit(True)).alias("ok"))


def read_stage(spark: SparkSession, path: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """A2: a stage's table; it must hold the target and a feature at least."""
    df = load_table(spark, path) if path.endswith((".csv", ".parquet")) else spark.read.parquet(path)
    if target not in df.columns:
        raise DataError(f"{path}: target {target!r} is not among {df.columns[:8]}.")
    if not [c for c in df.columns if c != target and c not in keys]:
        raise DataError(f"{path}: no feature columns.")
    return df


def write_schema(spark: SparkSession, schema: list[dict], path: str) -> None:
    """A5: the feature schema as JSON lines, in order (one line for each input column)."""
    schema_frame(spark, schema).coalesce(1).write.mode("overwrite").json(path)


def read_schema(spark: SparkSession, path: str) -> list[dict]:
    from tabforge.operators.encode import SCHEMA_DDL
    found = schema_from_frame(spark.read.schema(SCHEMA_DDL).json(path))
    if not found:
        raise DataError(f"{path}: the feature schema is empty.")
    return found
