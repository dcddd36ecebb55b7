"""Stage reports (A8) as one query over the log, decision and result tables.

Every report is rows ``stage, position, section, item, value``; sections come in
a fixed order and a missing table leaves its section out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.constants import SUPPORTED_METRICS

SECTIONS = ("steps", "decisions", "schema", "metrics", "verdict", "next steps")


def _rows(df: DataFrame, stage: Column | str, section: str, seq: Column, item: Column, value: Column) -> DataFrame:
    return df.select((F.lit(stage) if isinstance(stage, str) else stage).alias("stage"),
                     (F.lit(SECTIONS.index(section) * 1000) + seq.cast("int")).alias("position"), F.lit(section).alias("section"),
                     item.cast("string").alias("item"), value.cast("string").alias("value"))


def _number(c: str) -> Column:
    return F.format_number(F.col(c).cast("double"), 4)


def run_report(steps: DataFrame, decisions: DataFrame | None = None, schema: DataFrame | None = None, metrics: DataFrame | None = None,
               verdict: DataFrame | None = None, failure: DataFrame | None = None) -> DataFrame:
    """``steps`` and ``decisions`` as the run log keeps them, ``schema`` as
    ``schema_frame`` gives it, ``metrics`` a row per split with the weighted
    metrics, ``verdict`` as ``record_verdict`` and ``failure`` as ``failure_report``
    give them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    parts = [_rows(steps, F.col("stage"), "steps", F.col("seq"), F.col("tool"), F.concat_ws(
        " ", F.nullif("summary", F.lit("")), F.concat(F.lit("("), text("rows_before"), F.lit(" -> "), text("rows_after"), F.lit(" rows)"))))]
    if decisions is not None:
        parts.append(_rows(decisions, F.col("stage"), "decisions", F.col("seq"), F.col("issue"), F.concat(F.col("choice"), F.lit(" ("), F.col("rationale"), F.lit(")"))))
    if schema is not None:
        # named so that the order of a table does not matter
        detail = F.when(F.col("type") == "categorical", F.concat(F.lit("categorical, "), F.size("categories").cast("string"), F.lit(" categories"))).otherwise(F.col("type"))
        parts.append(_rows(schema, "prep", "schema", F.lit(0), F.col("name"), detail))
    if metrics is not None:
        tall = metrics.select("split", F.posexplode(F.array(*[F.struct(F.lit(m).alias("m"), _number(m).alias("v")) for m in SUPPORTED_METRICS])).alias("i", "x"))
        parts.append(_rows(tall, "evaluate", "metrics", F.col("i"), F.concat_ws(" ", "split", "x.m"), F.col("x.v")))
    if verdict is not None:
        items = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in (
            ("test_f1", _number("test_f1")), ("f1_gap", _number("f1_gap")), ("suggested_verdict", F.col("suggested_verdict")), ("verdict", F.col("verdict")),
            ("overrides_suggestion", F.col("overrides_suggestion").cast("string")), ("rationale", F.col("rationale")))])
        tall = verdict.select(F.posexplode(items).alias("i", "x"))
        parts.append(_rows(tall, "evaluate", "verdict", F.col("i"), F.col("x.n"), F.col("x.v")))
    if failure is not None:
        parts.append(_rows(failure.where("section = 'next steps'"), "deploy", "next steps", F.col("item"), F.col("item"), F.col("value")))
    return functools.reduce(DataFrame.unionByName, parts)
