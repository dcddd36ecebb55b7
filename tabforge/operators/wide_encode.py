"""One-hot encoding of columns with any number of categories.

Named 0/1 columns suit a few categories.  For more, the categories are a table,
``column_name, category, position``, numbered like the named columns would
be, and a row's dummies are one sparse vector.  Neither the categories nor their
number passes through the driver or a single task: they are range-partitioned in
order, counted per partition and numbered from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.constants import ENCODINGS
from tabforge.errors import ParamError
from tabforge.functions.exprs import col
from tabforge.operators.stats import tall_text
from tabforge.session import written


def category_index(df: DataFrame, columns: Sequence[str], strategy: str = "one_hot_full") -> DataFrame:
    """``column_name, category, position``: the columns' distinct values, sorted as
    text in the order of the columns, numbered from 0 across all of them.  With
    ``one_hot_drop_first`` the first of exactly two categories has no position."""
    if strategy not in ENCODINGS:
        raise ParamError(f"Unknown encoding strategy: {strategy}")
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    values = tall_text(df, list(columns)).where("v IS NOT NULL").distinct().select(order[F.col("name")].alias("o"), F.col("name").alias("column_name"), F.col("v").alias("category"))
    sizes = values.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("first"))
    drop = (F.col("n") == 2) & (F.col("category") == F.col("first")) & F.lit(strategy == "one_hot_drop_first")
    ranged = written(values.join(F.broadcast(sizes), "o").withColumn("gone", drop).repartitionByRange("o", "category").sortWithinPartitions("o", "category")
                     .withColumn("part", F.spark_partition_id()), "categories")
    # partitions are ranges in order, so what stands before a partition is a sum over a row for each of them
    per_part = ranged.groupBy("part").agg(F.count_if(~F.col("gone")).alias("k"))
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    inside = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(Window.partitionBy("part").orderBy("o", "category"))
    return ranged.withColumn("nth", inside).join(F.broadcast(offsets), "part").select(
        "column_name", "category", F.when(~F.col("gone"), F.col("offset") + F.col("nth") - 1).alias("position"))


def sparse_dummies(df: DataFrame, index: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, size, positions``: where the row's dummies are 1, in order, of ``size``
    in all.  A NULL and a category that the index does not have set none.  ``keys``
    must identify the rows."""
    size = index.agg(F.count("position").alias("size"))
    tall = df.select(*[col(k) for k in keys], F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("category")) for c in columns])).alias("x"))
    found = tall.select(*[col(k) for k in keys], "x.*").join(index, ["column_name", "category"], "left")
    rows = found.groupBy(*[col(k) for k in keys]).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return rows.join(F.broadcast(size)).select(*[col(k) for k in keys], "size", "positions")
