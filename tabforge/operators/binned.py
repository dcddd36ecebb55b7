"""Tree models of many rows, grown on counted bins.

A tree of Spark ML reads a feature only by its bin (``MAX_BINS`` of them), so all
rows that agree in their bins and their label are alike to it.  On many rows
they are counted first, in one pass and one small shuffle; a model is then grown
on these points, each standing for its ``n`` rows:

* a random forest by ``grow_forests``, a task for each tree: a point's weight is
  Poisson(n · rate), which is the sum of the draws of its rows.  A draw depends on the
  seed, the fit, the tree and the point's place in sorted order, never on
  partitions; tree ``i`` is the same however many trees there are, and a tree
  cut at a lesser depth is the one that is grown to it.  So one forest for each
  fold answers a grid's numbers of trees and depths.
* boosted trees by Spark's own ``GBTClassifier`` with the count as weight.

Nodes are split as Spark does: gini or entropy, least rows in a leaf, ceil(sqrt(m))
random features a node, no gain no split, sibling leaves of one class merged.  The
model that comes out is a Spark ML one with thresholds of the features themselves.

Thresholds are the middles between the values of a feature that has up to
``MAX_BINS`` of them, else its quantiles over all rows (Spark reads them off 10,000 sampled
rows).  Where features are many, and points with them, so that more than
``MAX_POINTS`` are left, ``count_points`` says None and the rows have to be read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.errors import DataError
from tabforge.functions.exprs import col
from tabforge.session import cut_lineage, delete_work, work_path

MAX_BINS = 32               # Spark's own default
MAX_POINTS = 1_000_000      # counted points of about 8 + m bytes that every task holds
MAX_NODES = 20_000_000      # of all trees that are grown at once
SKETCH = 2_000              # accuracy of the quantiles: a part of 1 / 60 of a bin

NODES = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, gain:double, "
         "leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>")


# --------------------------------------------------------------------- points
@dataclass
class Points:
    """Counted rows in sorted order; ``table`` has the same ones in the cluster."""
    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    edges: list[list[float]]
    table: DataFrame

    @property
    def widths(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]


def fit_edges(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Ascending thresholds of each feature: a row is in the first bin whose threshold is not below it."""
    x = {c: col(c).cast("double") for c in features}
    shares = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
    asked = [F.count_if(v.isNull() | F.isnan(v)).alias(f"u{i}") for i, v in enumerate(x.values())]
    asked += [F.max(v).alias(f"m{i}") for i, v in enumerate(x.values())]
    asked += [F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(x.values())]
    asked += [F.percentile_approx(v, shares, F.lit(SKETCH)).alias(f"q{i}") for i, v in enumerate(x.values())]
    row = df.agg(*asked).first()
    if unknown := [c for i, c in enumerate(features) if row[f"u{i}"]]:
        raise DataError(f"Features have no value in some rows: {unknown}")
    few = [i for i in range(len(features)) if row[f"d{i}"] <= 2 * MAX_BINS]
    values = df.agg(*[F.array_sort(F.collect_set(x[features[i]])).alias(f"v{i}") for i in few]).first() if few else {}
    out = []
    for i in range(len(features)):
        v = values[f"v{i}"] if i in few else []
        if 0 < len(v) <= MAX_BINS:
            out.append([(a + b) / 2 for a, b in zip(v, v[1:])])
        else:
            out.append(sorted({q for q in row[f"q{i}"] or [] if q < row[f"m{i}"]}))
    return out


def bin_of(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """The number of the value's bin, by halving."""
    if not edges:
        return F.lit(first)
    at = len(edges) // 2
    return F.when(value <= F.lit(edges[at]), bin_of(value, edges[:at], first)).otherwise(bin_of(value, edges[at + 1:], first + at + 1))


def count_points(df: DataFrame, features: Sequence[str], edges: list[list[float]], fold: str | None = None) -> Points | None:
    """Rows of ``df`` (column ``label`` and, if named, ``fold``) counted by bins; None if the points are too many."""
    names = [f"b{i}" for i in range(len(features))]
    binned = df.select(F.col("label").cast("int").alias("label"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
                       *[bin_of(col(c).cast("double"), e).cast("int").alias(b) for c, e, b in zip(features, edges, names)])
    table = cut_lineage(binned.groupBy("fold", "label", *names).agg(F.count(F.lit(1)).alias("n")))
    if table.count() > MAX_POINTS:
        return None
    got = {c: v.to_numpy() for c, v in zip(table.columns, table.toArrow().columns)}
    order = np.lexsort([got[c] for c in ("label", "fold", *reversed(names))])
    bins = np.stack([got[b][order] for b in names], axis=1).astype(np.uint8)
    return Points(bins, got["label"][order].astype(np.uint8), got["fold"][order], got["n"][order], edges, table)


# --------------------------------------------------------------------- forest
def _grower(shared, of: dict):
    """What a task runs; it is sent by value, so it names nothing of this package."""
    def impurity(one, total):
        f = [(total - one) / total, one / total]
        if of["impurity"] == "gini":
            return (1.0 - f[0] * f[0]) - f[1] * f[1]
        return -sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0) for p in f)

    def grow(job: tuple[int, int]):
        fit, number = job
        bins, label, fold, n, widths = shared.value
        rng = np.random.default_rng([of["seed"] % 2**63, fit, number])
        mine = np.flatnonzero(fold != fit)
        n = n[mine]
        if of["bootstrap"]:
            w = rng.poisson(n * of["rate"])
        else:
            w = n if of["rate"] == 1.0 else rng.binomial(n, of["rate"])
        at = mine[w > 0]
        w, b, y = w[w > 0].astype(float), bins[at], label[at].astype(np.int64)
        m = len(widths)
        pick = m if of["single"] else math.ceil(math.sqrt(m))
        feature, cut, child, level = [np.array([-1])], [np.array([-1])], [np.array([-1])], [np.array([0])]
        counts = [np.array([[w[y == 0].sum(), w[y == 1].sum()]])]
        made, node = 1, np.zeros(len(w), dtype=np.int64)       # node: its place in the last level
        for depth in range(of["depth"]):
            here = counts[-1]
            total, one = here.sum(axis=1), here[:, 1]
            live = np.flatnonzero((one > 0) & (one < total))
            if not len(live):
                break
            place = np.full(len(here), -1)
            place[live] = np.arange(len(live))
            node = place[node]
            inside = node >= 0
            node, w, b, y = node[inside], w[inside], b[inside], y[inside]
            total, one = total[live], one[live]
            chosen = np.ones((len(live), m), dtype=bool)
            if pick < m:
                chosen = rng.random((len(live), m)).argsort(axis=1).argsort(axis=1) < pick
            base, rows = impurity(one, total), np.arange(len(live))
            best, by, where, halves = np.zeros(len(live)), np.full(len(live), -1), np.zeros(len(live), dtype=np.int64), np.zeros((len(live), 2))
            for f in range(m):
                if widths[f] < 2:
                    continue
                h = np.bincount((node * widths[f] + b[:, f]) * 2 + y, weights=w, minlength=len(live) * widths[f] * 2).reshape(len(live), widths[f], 2)
                left = h.cumsum(axis=1)[:, :-1]
                lt, lo = left.sum(axis=2), left[:, :, 1]
                rt, ro = total[:, None] - lt, one[:, None] - lo
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = base[:, None] - lt / total[:, None] * impurity(lo, lt) - rt / total[:, None] * impurity(ro, rt)
                gain[(lt < of["least"]) | (rt < of["least"]) | ~chosen[:, f, None]] = -1.0
                top = gain.argmax(axis=1)
                better = gain[rows, top] > best
                best[better], by[better], where[better] = gain[rows, top][better], f, top[better]
                halves[better] = left[rows, top][better]
            split = np.flatnonzero(by >= 0)
            if not len(split):
                break
            ids = live[split]
            feature[-1][ids], cut[-1][ids], child[-1][ids] = by[split], where[split], made + 2 * np.arange(len(split))
            both = np.stack([halves[split], here[live][split] - halves[split]], axis=1).reshape(-1, 2)
            for part, value in ((feature, -1), (cut, -1), (child, -1), (level, depth + 1)):
                part.append(np.full(len(both), value))
            counts.append(both)
            made += len(both)
            place = np.full(len(live), -1)
            place[split] = np.arange(len(split))
            inside = place[node] >= 0
            node, w, b, y = node[inside], w[inside], b[inside], y[inside]
            node = place[node] * 2 + (b[np.arange(len(node)), by[node]] > where[node])
        return job, tuple(np.concatenate(x) for x in (feature, cut, child, level, counts))

    return grow


def forest_spec(est) -> dict:
    """What a tree of a Spark ``RandomForestClassifier`` depends on, its depth aside."""
    return {"impurity": est.getImpurity(), "least": est.getMinInstancesPerNode(), "rate": est.getSubsamplingRate(),
            "bootstrap": est.getBootstrap(), "seed": est.getSeed(), "single": est.getNumTrees() == 1}


def room(points: Points, ests: Sequence, fits: int) -> bool:
    """Whether the trees of all these forests are few enough to be held at once."""
    most = 2 * len(points.n)
    return sum(fits * e.getNumTrees() * min(2 ** (e.getMaxDepth() + 1), most) for e in ests) <= MAX_NODES


def grow_forests(spark: SparkSession, points: Points, ests: Sequence, fits: Sequence[int]) -> list[dict[int, list[tuple]]]:
    """For each forest that is asked for its trees by fit, all grown to a full depth of
    it; fit ``f`` leaves out the points of fold ``f``.  Forests that differ in depth or
    number of trees only are grown once."""
    shared = spark.sparkContext.broadcast((points.bins, points.label, points.fold, points.n, points.widths))
    specs = [forest_spec(e) for e in ests]
    grown: list[tuple[dict, dict]] = []
    for spec in specs:
        if any(spec == s for s, _ in grown):
            continue
        same = [e for e, s in zip(ests, specs) if s == spec]
        number, depth = max(e.getNumTrees() for e in same), max(e.getMaxDepth() for e in same)
        jobs = [(f, t) for f in fits for t in range(number)]
        tasks = min(len(jobs), 4 * spark.sparkContext.defaultParallelism)
        trees = dict(spark.sparkContext.parallelize(jobs, tasks).map(_grower(shared, spec | {"depth": depth})).collect())
        grown.append((spec, {f: [trees[f, t] for t in range(number)] for f in fits}))
    shared.destroy()
    out = []
    for e, spec in zip(ests, specs):
        trees = next(found for s, found in grown if s == spec)
        out.append({f: [cut_tree(t, e.getMaxDepth()) for t in trees[f][:e.getNumTrees()]] for f in fits})
    return out


def cut_tree(tree: tuple, depth: int) -> tuple:
    """The tree as if grown to ``depth`` only, sibling leaves of one class merged."""
    feature, cut, child, level, counts = tree
    leaf = (child < 0) | (level >= depth)
    one = counts[:, 1] > counts[:, 0]
    for at in range(min(depth, int(level[-1])) - 1, -1, -1):
        ids = np.flatnonzero((level == at) & ~leaf)
        left = child[ids]
        leaf[ids] = leaf[left] & leaf[left + 1] & (one[left] == one[left + 1])
    return feature, cut, np.where(leaf, -1, child), level, counts


def votes(trees: Sequence[tuple], bins: np.ndarray) -> np.ndarray:
    """Sums over the trees of the leaves' shares of both classes."""
    out = np.zeros((len(bins), 2))
    for feature, cut, child, _, counts in trees:
        node = np.zeros(len(bins), dtype=np.int64)
        going = np.arange(len(bins))
        while len(going := going[child[node[going]] >= 0]):
            at = node[going]
            node[going] = child[at] + (bins[going, feature[at]] > cut[at])
        share = counts / counts.sum(axis=1, keepdims=True)
        out += share[node]
    return out


def evaluate(label: np.ndarray, n: np.ndarray, raw: np.ndarray, metric: str) -> float:
    """Spark's multiclass metrics, or areaUnderROC, of counted points."""
    if metric == "areaUnderROC":
        order = np.argsort(-raw[:, 1], kind="stable")
        score = raw[order, 1]
        hits, misses = np.cumsum(n[order] * (label[order] == 1)), np.cumsum(n[order] * (label[order] == 0))
        last = np.append(score[1:] != score[:-1], True)
        y, x = np.append(0, hits[last]) / max(hits[-1], 1), np.append(0, misses[last]) / max(misses[-1], 1)
        return float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
    said = raw[:, 1] > raw[:, 0]
    table = np.bincount(label * 2 + said, weights=n, minlength=4).reshape(2, 2)
    actual, right, total = table.sum(axis=1), np.diag(table), table.sum()
    if metric == "accuracy":
        return float(right.sum() / total)
    precision = right / np.maximum(table.sum(axis=0), 1)
    recall = right / np.maximum(actual, 1)
    both = np.where(precision + recall > 0, precision + recall, 1.0)
    of = {"f1": 2 * precision * recall / both, "weightedPrecision": precision, "weightedRecall": recall}[metric]
    return float((of * actual).sum() / total)


# --------------------------------------------------------------------- models
def _impurity(kind: str, counts: Sequence[float]) -> float:
    shares = [c / sum(counts) for c in counts]
    return 1.0 - sum(p * p for p in shares) if kind == "gini" else -sum(p * math.log2(p) for p in shares if p)


def _node_rows(number: int, tree: tuple, kind: str, edges: list[list[float]]) -> list[tuple]:
    """The nodes of a tree as Spark ML saves them: numbered from the root, left side first."""
    feature, cut, child, _, counts = (x.tolist() for x in tree)
    order, ids, stack = [], {}, [0]
    while stack:
        at = stack.pop()
        ids[at] = len(order)
        order.append(at)
        if child[at] >= 0:
            stack += [child[at] + 1, child[at]]
    rows = []
    for at in order:
        total, pure = sum(counts[at]), _impurity(kind, counts[at])
        node = (ids[at], float(counts[at][1] > counts[at][0]), pure, counts[at], int(total))
        if (left := child[at]) < 0:
            rows.append((number, (*node, -1.0, -1, -1, (-1, [], -1))))
        else:
            gain = pure - sum(sum(counts[k]) / total * _impurity(kind, counts[k]) for k in (left, left + 1))
            rows.append((number, (*node, gain, ids[left], ids[left + 1], (feature[at], [edges[feature[at]][cut[at]]], -1))))
    return rows


def _with_nodes(model, nodes):
    """The model with the nodes that ``nodes`` makes of its own, by way of Spark ML's saved form."""
    spark = SparkSession.getActiveSession()
    path = work_path(spark, "model")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").collect()
    spark.createDataFrame(nodes(saved), NODES).write.mode("overwrite").parquet(f"{path}/data")
    found = type(model).load(path)
    delete_work(spark, path)
    return found


def forest_model(spark: SparkSession, est, trees: Sequence[tuple], edges: list[list[float]]):
    """The ``RandomForestClassificationModel`` of grown trees.  A fit on two rows gives its parameters."""
    two = spark.createDataFrame([(float(i), Vectors.dense([float(i)] * len(edges))) for i in (0, 1)], ["label", "features"])
    model = est.copy({est.subsamplingRate: 1.0}).fit(two)
    return _with_nodes(model, lambda _: [r for i, t in enumerate(trees) for r in _node_rows(i, t, est.getImpurity(), edges)])


def boosted_model(est, points: Points):
    """Spark's boosted trees of counted points, thresholds put back to the features' own."""
    names = [f"b{i}" for i in range(len(points.edges))]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(points.table.withColumn("label", F.col("label").cast("double")))
    # so many bins that no point is left out of the sample that thresholds are read off
    wide = max(MAX_BINS, math.isqrt(len(points.n)) + 1)
    model = est.copy({est.maxBins: wide, est.weightCol: "n"}).fit(rows.select("label", "features", F.col("n").cast("double").alias("n")))

    def own(saved):
        for r in saved:
            node = r.nodeData.asDict(recursive=True)
            if (f := node["split"]["featureIndex"]) >= 0:
                # a threshold between two bins, or on one where the bin after it is empty
                (at,) = node["split"]["leftCategoriesOrThreshold"]
                node["split"]["leftCategoriesOrThreshold"] = [points.edges[f][math.floor(at)]]
            yield r.treeID, node

    return _with_nodes(model, lambda saved: list(own(saved)))
