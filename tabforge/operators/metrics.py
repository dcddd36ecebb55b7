"""Evaluation metrics.

Everything derives from one ``groupBy(actual, predicted).count()`` (the
confusion table, k x k rows) or, for ROC/AUC, one ``groupBy(score)``.  ROC
cumulative sums are bucketed by quantiles of the distinct scores, so no window
holds many of them in one task however they pile up.  Rows without a score
(NULL or NaN) are in no ROC point and no AUC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.constants import MAX_CLASSES
from tabforge.errors import DataError
from tabforge.functions.exprs import col
from tabforge.operators.stats import label_values
from tabforge.session import written

ROC_BUCKETS = 128


def confusion(df: DataFrame, label: str, pred: str, classes: Sequence[str] | None = None) -> DataFrame:
    """(actual, predicted, n) for every class pair, zero cells included.

    The pairs are counted once, in one pass over ``df``; the labels and all that is
    made of the table are read from the written counts."""
    counts = written(df.groupBy(col(label).cast("string").alias("actual"),
                                col(pred).cast("string").alias("predicted")).agg(F.count("*").alias("n")), "confusion")
    if classes is None:
        classes = label_values(counts.select("actual").union(counts.select("predicted")))
    if len(classes) > MAX_CLASSES:      # the grid of pairs is broadcast
        raise DataError(f"{label} has more than {MAX_CLASSES} classes.")
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    return (F.broadcast(grid).join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def per_class(conf: DataFrame) -> DataFrame:
    """(class, tp, support, predicted, precision, recall, f1) from the confusion table."""
    sup = conf.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    prd = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("npred"))
    t = sup.join(prd, "cls", "full").select(
        "cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("npred", F.lit(0)).alias("npred"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def weighted_metrics(df: DataFrame, label: str, pred: str, classes: Sequence[str] | None = None) -> DataFrame:
    """One row: accuracy, precision/recall/f1 weighted by support."""
    pc = per_class(confusion(df, label, pred, classes))
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def metrics_dict(df: DataFrame, label: str, pred: str, classes: Sequence[str] | None = None) -> dict:
    return weighted_metrics(df, label, pred, classes).collect()[0].asDict()


def classification_report(df: DataFrame, label: str, pred: str,
                          classes: Sequence[str] | None = None) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg."""
    pc = per_class(confusion(df, label, pred, classes))
    rows = pc.select(F.col("cls").alias("row_name"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    tot = pc.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("s")).alias("f1"),
                     F.col("s").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg"), "mp", "mr", "mf", F.col("s").cast("bigint"))
    weighted = tot.select(F.lit("weighted avg"), "wp", "wr", "wf", F.col("s").cast("bigint"))
    return rows.unionByName(acc).union(macro).union(weighted)


def _score_counts(df: DataFrame, label: str, score: str, positive: str) -> DataFrame:
    is_pos = (col(label).cast("string") == F.lit(positive)).cast("bigint")
    scored = df.where(col(score).isNotNull() & ~F.isnan(col(score).cast("double")))
    counts = scored.groupBy(col(score).cast("double").alias("s")).agg(
        F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg"))
    return written(counts, "scores")        # read for the bounds, the bucket sums and the points


def _cumulative_desc(sc: DataFrame) -> DataFrame:
    """Add pos_gt / neg_gt (counts with a strictly higher score) without a global window."""
    bounds = sorted(set(sc.approxQuantile("s", [i / ROC_BUCKETS for i in range(1, ROC_BUCKETS)], 0.2 / ROC_BUCKETS)))
    # bucket 0 holds the highest scores; a bound is the least score of its bucket
    below = F.array(*[F.lit(float(x)) for x in bounds]) if bounds else F.array().cast("array<double>")
    sb = sc.withColumn("b", F.lit(len(bounds)) - F.size(F.filter(below, lambda x: x <= F.col("s"))))
    tot = sb.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wb = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("b", F.coalesce(F.sum("bp").over(wb), F.lit(0)).alias("op"),
                     F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("on"))
    wi = Window.partitionBy("b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (sb.join(off, "b")
            .withColumn("pos_gt", F.col("op") + F.coalesce(F.sum("pos").over(wi), F.lit(0)))
            .withColumn("neg_gt", F.col("on") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
            .drop("op", "on", "b"))


def roc_points(df: DataFrame, label: str, score: str, positive: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (descending) plus the origin."""
    sc = _score_counts(df, label, score, positive)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    P, N = tot["P"], tot["N"]
    cum = _cumulative_desc(sc)
    pts = cum.select(F.col("s").alias("threshold"),
                     F.try_divide(F.col("neg_gt") + F.col("neg"), F.lit(N)).alias("fpr"),
                     F.try_divide(F.col("pos_gt") + F.col("pos"), F.lit(P)).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, label: str, score: str, positive: str) -> DataFrame:
    """Exact AUC (ties count one half): sum over scores of neg * (pos above + pos equal / 2)."""
    sc = _score_counts(df, label, score, positive)
    cum = _cumulative_desc(sc)
    return cum.agg(F.try_divide(F.sum(F.col("neg").cast("double") * (F.col("pos_gt") + F.col("pos") / 2.0)),
                                F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
