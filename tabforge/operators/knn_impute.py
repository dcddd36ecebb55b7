"""kNN imputation.

For each numeric column c that has nulls ("knn columns", K of them):

* receivers are rows with c NULL, donors rows with c present;
* the distance uses the knn columns present in *both* rows, scaled as
  sqrt(K / |common| * sum of squared differences) (nan-euclidean);
* the imputed value is the uniform mean of c over the k nearest donors
  (k = min(5, rows - 1)); a receiver sharing no coordinate with any donor
  gets the column mean.  Every column is imputed from the original values.

Which columns a row has is data: its pattern is a join key.  The receivers'
and donors' patterns of a column give the pairs that occur and the columns
these have in common; a space is a column, a donor pattern and a set of common
columns, with the other coordinates at 0.  One kNN join answers every receiver
of every column in all its spaces, so the number of jobs does not follow the
columns or the patterns.

In a space donors with equal coordinates are one point with its first k donors in
hash order (the only ones that can count), and receivers with equal coordinates
share one answer.  Of donors equally near come first those of the point whose
first donor is first in hash order, and in a point they come in hash order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.exprs import col, is_numeric_type
from tabforge.operators import sampling
from tabforge.operators.impute import columns_with_nulls
from tabforge.operators.knn import nearest
from tabforge.session import cut_lineage, written


def _common(a: Column, b: Column, size: int) -> Column:
    """The pattern of the columns that two patterns have: '1' for each of them."""
    return F.concat(*[F.when((F.substring(a, i + 1, 1) == "1") & (F.substring(b, i + 1, 1) == "1"), "1").otherwise("0") for i in range(size)])


def _masked(x: str, pattern: str, size: int) -> Column:
    """The coordinates of the pattern's columns; 0 elsewhere."""
    return F.array(*[F.when(F.substring(pattern, i + 1, 1) == "1", F.col(x)[i]).otherwise(F.lit(0.0)) for i in range(size)])


def knn_impute(df: DataFrame, target: str, columns: Sequence[str] | None = None, keys: Sequence[str] = (),
               n_neighbors: int = 5, seed: int = 42) -> tuple[DataFrame, dict]:
    cand_cols = list(columns) if columns else [c for c in df.columns if c != target and c not in keys]
    numeric = [c for c in cand_cols if c in df.columns and is_numeric_type(df.schema[c].dataType)]
    kcols = columns_with_nulls(df, numeric)
    if not kcols:
        return df, {"strategy": "knn", "knn_columns": []}
    base = cut_lineage(df.withColumn("__ord", sampling.row_order(df, keys, seed)[0]).withColumn("__rid", F.monotonically_increasing_id()))
    size = len(kcols)
    values = [col(c).cast("double") for c in kcols]
    row = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    k = min(n_neighbors, max(1, row.n - 1))
    # a row for each column: its value there, and which of the other columns it has
    here = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("val"), F.concat(*[
        F.lit("0") if i == j else F.when(o.isNotNull(), "1").otherwise("0") for j, o in enumerate(values)]).alias("pat")) for i, v in enumerate(values)])
    tall = base.select("__rid", "__ord", F.array(*values).alias("at"), F.explode(here).alias("h")).select(
        "__rid", "__ord", "h.c", "h.val", "h.pat", _masked("at", "h.pat", size).alias("at"))
    receivers, donors = tall.where("val IS NULL"), tall.where("val IS NOT NULL")
    asked = written(receivers.select("c", "pat", "at").distinct().withColumn("qid", F.monotonically_increasing_id()), "receivers")
    pairs = asked.select("c", F.col("pat").alias("pr")).distinct().join(donors.select("c", F.col("pat").alias("pd")).distinct(), "c")
    spaces = written(pairs.withColumn("shared", _common(F.col("pr"), F.col("pd"), size)).where(F.col("shared").contains("1")).withColumn(
        "space", F.concat_ws("_", F.col("c").cast("string"), "pd", "shared")), "spaces")

    sent = donors.join(spaces.select("c", F.col("pd").alias("pat"), "shared", "space").distinct(), ["c", "pat"])
    first = Window.partitionBy("space", "x").orderBy("__ord")
    kept = sent.select("space", _masked("at", "shared", size).alias("x"), "__ord", "val").withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= k)
    points = kept.groupBy("space", "x").agg(F.array_sort(F.collect_list(F.struct("__ord", "val"))).alias("d")).select(
        "space", F.conv(F.substring(F.col("d")[0]["__ord"], 1, 15), 16, 10).cast("long").alias("pid"), "x", F.size("d").alias("m"), F.col("d.val").alias("load"))
    queries = asked.withColumnRenamed("pat", "pr").join(spaces, ["c", "pr"]).select(
        "qid", "space", _masked("at", "shared", size).alias("x"), F.lit(None).cast("long").alias("skip"),
        F.lit(float(size)).alias("num"), F.length(F.regexp_replace("shared", "0", "")).cast("double").alias("den"))
    near = nearest(queries, points, size, k)
    total = F.aggregate(F.slice("load", F.lit(1), F.col("take").cast("int")), F.lit(0.0), lambda a, v: a + v)
    means = near.groupBy("qid").agg((F.sum(total) / F.sum("take")).alias("value"))
    given = receivers.select("__rid", "c", "pat", "at").join(asked, ["c", "pat", "at"]).join(means, "qid")
    wide = given.groupBy("__rid").agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(f"__i{i}") for i in range(size)])
    out = base.join(wide, "__rid", "left")
    place = {c: i for i, c in enumerate(kcols)}
    chosen = [F.coalesce(col(f.name).cast("double"), F.col(f"__i{place[f.name]}"), F.lit(row[f"m{place[f.name]}"])).alias(f.name)
              if f.name in place else col(f.name) for f in df.schema.fields]
    return out.select(*chosen), {"strategy": "knn", "knn_columns": kcols, "k": k}
