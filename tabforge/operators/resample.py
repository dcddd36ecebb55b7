"""Class rebalancing: undersample, SMOTE, SMOTE-NC (H1-H4).

SMOTE adds (majority - minority) synthetic minority rows.  Each minority row
gets a dense hash rank r; synthetic ordinal o = copy * n_minority + r spreads
the new rows evenly over the minority rows.  For ordinal o the neighbour slot
(of k) and the gap u in [0, 1) come from md5 of (seed, o), so the output is
deterministic.  Neighbours come from the exact kNN over *distinct* minority
coordinates (duplicates are one point with a multiplicity).

SMOTE-NC treats 0/1 columns as categories: in the distance a mismatch costs
median_std^2 / 2 (each 0/1 column is scaled by median_std / sqrt(2), where
median_std is the median population std of the continuous minority
columns); the synthetic value is the most frequent value among the k
neighbours (ties -> the smaller value).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.constants import BALANCE_METHODS, DEFAULT_SEED, IMBALANCE_RATIO
from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col, hash_int, hash_uniform
from tabforge.operators import sampling
from tabforge.operators.knn import expand_neighbours, nearest
from tabforge.operators.profile import imbalance
from tabforge.session import cut_lineage


def binary_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose values all lie in {0, 1} (one aggregation)."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(~col(c).cast("double").isin(0.0, 1.0)).alias(f"b{i}")
                   for i, c in enumerate(columns)]).collect()[0]
    return [c for i, c in enumerate(columns) if row[f"b{i}"] == 0]


def _median(vals):
    v = sorted(x for x in vals if x is not None)
    if not v:
        return 0.0
    n = len(v)
    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def _load(i: int, neighbour: Column) -> Column:
    return neighbour["load"][i]


def _vote(values: Column) -> Column:
    """The most frequent value of an array; of equally frequent ones the least."""
    def more(best: Column, v: Column) -> Column:
        n = F.size(F.filter(values, lambda x: x == v))
        return F.when(n > best["n"], F.struct(n.alias("n"), v.alias("v"))).otherwise(best)

    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.array_sort(F.array_distinct(values)), zero, more, lambda best: best["v"])


def smote(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], minority_label: str,
          need: int, k: int, seed: int = DEFAULT_SEED, categorical: Sequence[str] = ()) -> DataFrame:
    """Synthetic minority rows (same schema as ``df``; keys NULL)."""
    features = list(features)
    cats = [c for c in features if c in set(categorical)]
    conts = [c for c in features if c not in set(cats)]
    mino = df.where(col(target).cast("string") == F.lit(minority_label))
    row = mino.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"z{i}") for i, c in enumerate(features)]).first()
    n_min, empty = row.n, [c for i, c in enumerate(features) if row[f"z{i}"]]
    if n_min < 2:
        raise DataError(f"SMOTE needs at least 2 minority rows, found {n_min}.")
    if empty:
        raise DataError(f"SMOTE: minority rows have nulls in {empty}; impute before balancing.")
    scale = {c: 1.0 for c in conts}
    if cats:
        sds = mino.agg(*[F.stddev_pop(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(conts)]) \
            .collect()[0] if conts else {}
        med = _median([sds[f"s{i}"] for i in range(len(conts))]) if conts else 0.0
        for c in cats:
            scale[c] = med / math.sqrt(2.0)
    hk = list(keys) if keys else features
    order, _ = sampling.row_order(mino, hk, seed)
    # distinct coordinates with their copies; a place's number comes from its first row in hash order
    places = mino.select(*[col(c).cast("double").alias(f"__g{i}") for i, c in enumerate(features)], order.alias("__h")).groupBy(
        *[f"__g{i}" for i in range(len(features))]).agg(F.count(F.lit(1)).alias("m"), F.min("__h").alias("__h"))
    at = [F.col(f"__g{i}") for i in range(len(features))]
    groups = cut_lineage(places.select(F.conv(F.substring("__h", 1, 15), 16, 10).cast("long").alias("gid"), "m", *at, F.array(*at).alias("load"),
                                       F.array(*[a * F.lit(float(scale[c])) for a, c in zip(at, features)]).alias("x")))
    space = F.lit("minority").alias("space")
    nn = nearest(groups.select(F.col("gid").alias("qid"), space, "x", F.col("gid").alias("skip")),
                 groups.select(space, F.col("gid").alias("pid"), "x", "m", "load"), len(features), k)
    near = expand_neighbours(nn).groupBy(F.col("qid").alias("gid")).agg(F.array_sort(F.collect_list(F.struct("nn_idx", "load"))).alias("__near"))

    # base rows: dense hash rank, then copies spread round-robin
    ranked = sampling.hash_rank(mino, hk, seed, n_max=n_min, rank_col="__r")
    ranked = ranked.join(groups.select("gid", *at), [col(c).cast("double") == a for c, a in zip(features, at)])
    base, extra = divmod(need, n_min)
    copies = F.lit(base) + F.when(F.col("__r") < extra, 1).otherwise(0)
    syn = (ranked.where(copies > 0)
           .select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("__c"))
           .withColumn("__o", F.col("__c") * F.lit(n_min) + F.col("__r")))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__o").cast("string")))
    syn = syn.withColumn("__u", hash_uniform(h, 8)).withColumn("__s", (hash_int(h, 0) % F.lit(k)).cast("int")).join(near, "gid")
    there = F.get("__near", F.col("__s"))["load"]
    place = {c: i for i, c in enumerate(features)}
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in conts:
            v = col(c).cast("double") + F.col("__u") * (there[place[c]] - col(c).cast("double"))
            out.append(v.cast(f.dataType).alias(c) if f.dataType.typeName() in ("double", "float") else v.alias(c))
        elif c in cats:
            out.append(_vote(F.transform("__near", functools.partial(_load, place[c]))).cast(f.dataType).alias(c))
        elif c == target:
            out.append(col(c))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(c))
    return syn.select(*out)


def balance_classes(df: DataFrame, method: str, target: str, keys: Sequence[str] = (),
                    ratio: float = IMBALANCE_RATIO, seed: int = DEFAULT_SEED) -> tuple[DataFrame, dict]:
    """H4: act only when imbalanced; report requested vs applied method."""
    if method not in BALANCE_METHODS:
        raise ParamError(f"Unknown balance method: {method}; use one of {BALANCE_METHODS}")
    info = imbalance(df, target, ratio)
    out = {"method_requested": method, "method_applied": "none", "imbalance_info": info}
    if method == "none" or not info["imbalanced"]:
        return df, out
    counts = info["class_counts"]
    if method == "undersample":
        res = sampling.undersample(df, target, sampling_keys(df, keys, target), seed)
        out["method_applied"] = "undersample"
        return res, out
    feats = [c for c in df.columns if c != target and c not in keys]
    cats = binary_columns(df, feats)
    applied = "smotenc" if cats else "smote"
    minority = min(counts, key=lambda c: (counts[c], c))
    majority_n = max(counts.values())
    need = majority_n - counts[minority]
    k = max(1, min(5, counts[minority] - 1))
    syn = smote(df, target, keys, feats, minority, need, k, seed, categorical=cats)
    out["method_applied"] = applied
    out["synthetic_rows"] = need
    return df.unionByName(syn), out


def sampling_keys(df: DataFrame, keys: Sequence[str], target: str) -> list[str]:
    return list(keys) if keys else [c for c in df.columns]
