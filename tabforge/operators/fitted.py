"""Preparation as fit and apply: one saved object for every later table.

``fit`` learns from one table, normally the training side of a split, what the
preparation needs: the columns to drop, the fences, the fill values, the
categories with their dummy columns, the columns that selection keeps and, where
asked for, means and deviations.  ``apply`` is then a chain of projections
(and one filter, where outliers are removed) with these values as literals, so
it learns nothing from the table it is applied to and works on streams too.

The object is plain JSON and goes with a model bundle.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import DEFAULT_SEED, IMBALANCE_RATIO
from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col, is_numeric_type, parse_number
from tabforge.operators import encode, impute, normalize, outliers, select

OUTLIERS = ("iqr_remove", "iqr_cap", "skip")
IMPUTATIONS = ("median", "mode", "skip")


@dataclasses.dataclass
class FittedPrep:
    target: str
    keys: list[str]
    dropped: list[str]
    outliers: str
    fences: dict[str, dict]
    fills: dict[str, object]
    numeric_text: list[str]         # text columns whose values are numbers
    groups: dict[str, dict]
    features: list[str]
    scaling: dict[str, list[float]]
    schema: list[dict]

    def apply(self, df: DataFrame, keep_outliers: bool = False) -> DataFrame:
        """The prepared table: keys, features, and the target where it is there.
        With ``keep_outliers`` no row is removed (a table to score)."""
        df = normalize.integrate(df)
        absent = [c for c in {*self.fences, *self.fills, *self.groups, *self.numeric_text, *self.plain()} if c not in df.columns]
        if absent:
            raise DataError(f"Columns that the preparation was fitted on are missing: {sorted(absent)[:5]}.")
        df = df.drop(*[c for c in self.dropped if c in df.columns and c not in self.keys])
        if self.outliers == "iqr_cap":
            df = outliers.cap_outliers(df, self.target, fences=self.fences)
        elif self.outliers == "iqr_remove" and not keep_outliers:
            df = outliers.remove_outliers(df, self.target, fences=self.fences)
        df = impute.apply_fill(df, self.fills)
        labelled = self.target in df.columns
        df = impute.drop_rows_null_target(df, self.target) if labelled else df.withColumn(self.target, F.lit(None).cast("int"))
        df = df.select(*[parse_number(col(c)).alias(c) if c in self.numeric_text else col(c) for c in df.columns])
        df = encode.apply_one_hot(df, self.target, self.groups, self.keys)
        out = [col(c) for c in self.keys if c in df.columns]
        for c in self.features:
            mean, deviation = self.scaling.get(c, (0.0, 1.0))
            out.append(((col(c).cast("double") - F.lit(mean)) / F.lit(deviation)).alias(c) if c in self.scaling else col(c))
        return df.select(*out, *([col(self.target)] if labelled else []))

    def plain(self) -> list[str]:
        dummies = {d for g in self.groups.values() for d, _ in g["dummies"]}
        return [c for c in self.features if c not in dummies]

    def fill_values(self) -> dict[str, float]:
        """What a raw numeric field that is missing stands for when a row is scored."""
        return {c: float(v) for c, v in self.fills.items() if isinstance(v, int | float)}

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FittedPrep:
        found = json.loads(text)
        wrong = {f.name for f in dataclasses.fields(cls)} ^ set(found)
        if wrong:
            raise DataError(f"Not a fitted preparation: {sorted(wrong)} differ.")
        for g in found["groups"].values():
            g["dummies"] = [tuple(d) for d in g["dummies"]]
        return cls(**found)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> FittedPrep:
        return cls.from_json(spark.read.text(path).first()[0])


def fit(df: DataFrame, target: str, keys: Sequence[str] = (), manual_drops: Sequence[str] = (), outlier: str = "iqr_remove",
        imputation: str = "median", encoding: str = "one_hot_drop_first", correlation: str = "both", scale: bool = False) -> FittedPrep:
    """Learn the preparation from one table.  Later steps learn from what the steps
    before them make of it."""
    if outlier not in OUTLIERS:
        raise ParamError(f"Unknown outlier strategy: {outlier}")
    if imputation not in IMPUTATIONS:
        raise ParamError(f"{imputation}: only {IMPUTATIONS} can be fitted on one table and applied to another.")
    keys = list(keys)
    df = normalize.integrate(df)
    if target not in df.columns:
        raise DataError(f"Target '{target}' not in columns {df.columns}.")
    # id-like columns go before anything is learnt, so no later table needs to have them
    dropped = normalize.excluded_columns(df.drop(*keys), target, manual_drops)
    df, dropped = normalize.drop_columns(df, [c for c in dropped if c not in keys], target)
    fences = outliers.fit_fences(df, target, keys=keys) if outlier != "skip" else {}
    fences = {c: f for c, f in fences.items() if f["applies"]}
    if outlier == "iqr_remove":
        df = outliers.remove_outliers(df, target, fences=fences)
    elif outlier == "iqr_cap":
        df = outliers.cap_outliers(df, target, fences=fences)
    fills = impute.fit_fill_values(df, imputation, target, keys=keys) if imputation != "skip" else {}
    # a column without nulls here may have some in another table
    rest = [c for c in df.columns if c not in (*keys, target, *fills)]
    if imputation != "skip":
        fills |= _other_fills(df, rest, imputation)
    fills = {c: v for c, v in fills.items() if v is not None}
    df = impute.drop_rows_null_target(impute.apply_fill(df, fills), target)
    encoded, info = encode.encode_features(df, encoding, target, keys=keys, manual_drops=dropped)
    kept, _ = select.filter_by_correlation(encoded, correlation, target, keys=keys)
    excluded = set(info["excluded"])
    features = [c for c in kept.columns if c != target and c not in keys and c not in excluded]
    if not features:
        raise DataError("No feature columns are left.")
    schema = encode.build_input_schema(info["pre_encode"], info["groups"], features, info["excluded"], keys)
    scaling = {}
    if scale:
        row = kept.agg(*[f(col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scaling = {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(features) if row[f"s{i}"]}
    return FittedPrep(target, keys, list(dict.fromkeys([*dropped, *info["excluded"]])), outlier, fences, fills, info["converted"], info["groups"],
                      features, scaling, schema)


def _other_fills(df: DataFrame, columns: list[str], imputation: str) -> dict[str, object]:
    from tabforge.operators import stats
    numeric = [c for c in columns if is_numeric_type(df.schema[c].dataType)]
    text = [c for c in columns if c not in numeric]
    found = stats.medians(df, numeric) if imputation == "median" else stats.modes(df, numeric, numeric=True)
    return {**found, **{c: "unknown" if v is None else v for c, v in stats.modes(df, text, numeric=False).items()}}


def leak_free(df: DataFrame, target: str, keys: Sequence[str] = (), test_size: float = 0.2, stratify: bool = True, balance: str = "none",
              ratio: float = IMBALANCE_RATIO, seed: int = DEFAULT_SEED, **options) -> tuple[DataFrame, DataFrame, FittedPrep]:
    """Split first, fit on the training side, apply to both.  Only the training side
    is balanced, and the test side keeps its outliers: nothing of it is learnt,
    made up or left out."""
    from tabforge.operators import sampling
    from tabforge.operators.resample import balance_classes
    labelled = impute.drop_rows_null_target(normalize.integrate(df), target)
    sides = sampling.split(labelled, target, list(keys), test_size=test_size, stratify=stratify, seed=seed)
    train, test = (sides.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    # every fit scans the training side; its rows are hashed once for all of them
    sides.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = fit(train, target, keys, **options)
    finally:
        sides.unpersist()
    ready = fitted.apply(train)
    if balance != "none":
        ready, _ = balance_classes(ready, balance, target, keys=list(keys), ratio=ratio, seed=seed)
    return ready, fitted.apply(test, keep_outliers=True), fitted
