"""Profiles, class balance and rule-based recommendations.

A profile is one wide aggregation (row count, null counts, means) plus one
tall value-count shuffle (distinct counts, top values); nothing row-level is
collected.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.constants import IMBALANCE_RATIO, MAX_GRID_COMBINATIONS, SPLIT_SIZE_RULE, TRAIN_RULE, TUNABLE_PARAMS, VALIDATION_SIZE
from tabforge.functions.exprs import col, is_numeric_type
from tabforge.operators import stats
from tabforge.operators.normalize import detect_id_like


def profile_columns(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(column_name, dtype, kind, missing_pct, nunique, mean) per column.

    ``kind`` is numeric/categorical for features and NULL for the target;
    ``mean`` is set for numeric features only.
    """
    cols = [c for c in df.columns if c not in keys]
    numeric = [c for c in cols if c != target and is_numeric_type(df.schema[c].dataType)]
    wide = df.agg(F.count("*").alias("__rows"),
                  *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)]).collect()[0]
    rows = wide["__rows"]
    means = {c: wide[f"m{i}"] for i, c in enumerate(numeric)}
    meta = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString(),
          None if c == target else ("numeric" if c in numeric else "categorical"), means.get(c))
         for i, c in enumerate(cols)],
        "pos int, column_name string, dtype string, kind string, mean double")
    out = F.broadcast(meta).join(stats.distinct_counts(df, cols), "column_name")
    mean_col = F.col("mean")
    return out.select(
        "pos", "column_name", "dtype", "kind",
        F.round(F.try_divide(F.col("nulls"), F.lit(rows)), 4).alias("missing_pct"),
        F.col("nunique").cast("bigint").alias("nunique"),
        F.when(F.col("kind") == "numeric", mean_col).cast("double").alias("mean"),
    )


def top_values(df: DataFrame, target: str, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Top-k values (nulls counted) of every categorical feature."""
    cats = [c for c in df.columns if c != target and c not in keys
            and not is_numeric_type(df.schema[c].dataType)]
    return stats.top_values(df, cats, k)


def class_counts(df: DataFrame, target: str, include_null: bool = True) -> DataFrame:
    """(target_class, n) — null counted as a class unless ``include_null`` is False."""
    base = df if include_null else df.where(col(target).isNotNull())
    return base.groupBy(col(target).cast("string").alias("target_class")).agg(F.count("*").alias("n"))


def class_balance(df: DataFrame, target: str, include_null: bool = True,
                  ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """Per class: n, majority, minority, minority/majority (4 dp), imbalanced.

    The window runs over the class-count table (one row per class), not rows.
    """
    cc = class_counts(df, target, include_null)
    w = Window.partitionBy()
    nn = Window.partitionBy()
    out = cc.select(
        "target_class", "n",
        F.max("n").over(w).alias("majority"),
        F.min("n").over(w).alias("minority"),
        F.count_if(F.col("target_class").isNotNull()).over(nn).alias("__k"),
        F.min(F.when(F.col("target_class").isNotNull(), F.col("n"))).over(nn).alias("__mn"),
        F.max(F.when(F.col("target_class").isNotNull(), F.col("n"))).over(nn).alias("__mx"),
    )
    ratio_col = F.coalesce(F.round(F.try_divide(F.col("minority"), F.col("majority")), 4), F.lit(1.0))
    imb = (F.col("__k") >= 2) & (F.try_divide(F.col("__mn"), F.col("__mx")) < F.lit(ratio))
    return out.select("target_class", "n", "majority", "minority",
                      ratio_col.cast("double").alias("ratio"), F.coalesce(imb, F.lit(False)).alias("imbalanced"))


def imbalance(df: DataFrame, target: str, ratio: float = IMBALANCE_RATIO) -> dict:
    """D3: counts, ratio and flag of ``class_balance`` over the rows that have a class."""
    table = class_balance(df, target, include_null=False, ratio=ratio).collect()
    any_row = table[0].asDict() if table else {"ratio": 1.0, "imbalanced": False}
    return {"class_counts": {r.target_class: r.n for r in table},
            "ratio": any_row["ratio"], "imbalanced": any_row["imbalanced"], "limit": ratio}


def prep_recommendations(df: DataFrame, target: str, keys: Sequence[str] = (),
                         ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: id-like columns, impute?, encoding, balance method.

    Class counts include a null class, as the profile does.
    """
    feats = [c for c in df.columns if c != target and c not in keys]
    cats = [c for c in feats if not is_numeric_type(df.schema[c].dataType)]
    agg = df.agg(
        F.count("*").alias("rows"),
        F.max(functools.reduce(operator.or_, [col(c).isNull() for c in feats])).alias("has_missing")
        if feats else F.lit(False).alias("has_missing"))
    cc = class_counts(df, target, include_null=True).agg(
        F.max("n").alias("mx"), F.min("n").alias("mn"))
    id_like = ",".join(detect_id_like([c for c in df.columns if c not in keys], target))
    r = cc.collect()[0]
    class_ratio = (r["mn"] / r["mx"]) if r["mx"] else 1.0
    balance = ("smotenc" if class_ratio < ratio and cats else "smote" if class_ratio < ratio else "none")
    return agg.select(
        F.col("rows").cast("bigint").alias("rows"),
        F.lit(id_like).alias("id_like_columns"),
        F.col("has_missing").alias("apply_imputation"),
        F.lit("one_hot_drop_first").alias("suggested_encoding"),
        F.lit(balance).alias("suggested_balance"),
        F.lit(round(class_ratio, 4)).cast("double").alias("class_ratio"),
    )


def split_recommendation(df: DataFrame, target: str) -> DataFrame:
    """rows -> test size by the split rule; stratify iff minority >= 2."""
    cc = class_counts(df, target, include_null=False)
    s = cc.agg(F.sum("n").alias("rows"), F.max("n").alias("majority_count"),
               F.min("n").alias("minority_count"))
    size = None
    for limit, v in SPLIT_SIZE_RULE:
        cond = F.col("rows") < limit if limit is not None else None
        size = (F.when(cond, F.lit(v)) if size is None else size.when(cond, F.lit(v))) if cond is not None \
            else size.otherwise(F.lit(v))
    return s.select(
        F.col("rows").cast("bigint").alias("rows"),
        F.col("majority_count").cast("bigint").alias("majority_count"),
        F.col("minority_count").cast("bigint").alias("minority_count"),
        F.coalesce(F.round(F.try_divide(F.col("minority_count"), F.col("majority_count")), 4),
                   F.lit(1.0)).alias("ratio"),
        size.cast("double").alias("test_size"),
        (F.col("minority_count") >= 2).alias("stratify"),
        F.lit(42).alias("random_state"),
    )


def parameter_catalogue(spark) -> DataFrame:
    """A row per algorithm and parameter that a search may vary, and the
    largest grid."""
    rows = [(a, i, p, MAX_GRID_COMBINATIONS) for a, names in TUNABLE_PARAMS.items() for i, p in enumerate(names, 1)]
    return spark.createDataFrame(rows, "algorithm string, position int, parameter string, max_grid_combinations int")


def recommended_search(df: DataFrame, target: str) -> DataFrame:
    """The recommended algorithm with the parameters that its search may vary."""
    rec = train_recommendation(df, target)
    return rec.join(F.broadcast(parameter_catalogue(df.sparkSession)), "algorithm")


def train_recommendation(df: DataFrame, target: str) -> DataFrame:
    """rows -> algorithm and whether to tune."""
    s = df.agg(F.count("*").alias("rows"))
    algo = tune = None
    for limit, a, t in TRAIN_RULE:
        if limit is None:
            algo, tune = algo.otherwise(F.lit(a)), tune.otherwise(F.lit(t))
        else:
            cond = F.col("rows") < limit
            algo = F.when(cond, F.lit(a)) if algo is None else algo.when(cond, F.lit(a))
            tune = F.when(cond, F.lit(t)) if tune is None else tune.when(cond, F.lit(t))
    return s.select(F.col("rows").cast("bigint").alias("rows"), algo.alias("algorithm"),
                    tune.alias("tune"), F.lit(VALIDATION_SIZE).alias("validation_size"),
                    F.lit("f1_weighted").alias("scoring"))
