"""Exact k-nearest-neighbour join on a space-partitioning tree (SMOTE, kNN impute).

Points are *distinct* coordinates with a multiplicity ``m`` (a third of the rows
at one place are one point), in one or more spaces: a query meets the points of
its own space only, and one query may ask several spaces.

The tree adapts to the data.  Round by round each node of more than ``LEAF``
points is cut along its widest dimension at the median, or at 3 or 7 (``FAN`` - 1)
quantiles where it is that much larger, of its own points (at the middle where the quantiles coincide), so heavy tails and
clusters give small boxes where the points are and no dimension is left out.
Every node has its bounding box and the copies it holds.

A query goes down to the nearest box at each level.  On its way the least
distance to the far corner of a box with enough copies bounds its k-th
distance; the leaf it ends in lowers the bound.  Then it goes down from the
root again, into all boxes not farther than the bound, and visits their leaves.
Queries and nodes meet in joins, queries and the points of a leaf in groups of
at most ``PART`` queries and ``LEAF`` points, so no task holds more.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import written

LEAF = 256
FAN = 8
PART = 4096


def _sum(terms: list[Column]) -> Column:
    return functools.reduce(operator.add, terms, F.lit(0.0))


def box_distance(x: str, dims: int) -> Column:
    """From the point to the box ``lo``, ``hi``: never more than the rounded
    distance to a point in it, as each operation is rounded alike."""
    far = [F.greatest(F.col("lo")[i] - F.col(x)[i], F.col(x)[i] - F.col("hi")[i], F.lit(0.0)) for i in range(dims)]
    return F.sqrt(_sum([d * d for d in far]) * F.col("num") / F.col("den"))


def corner_distance(x: str, dims: int) -> Column:
    """From the point to the farthest corner of the box."""
    far = [F.greatest(F.abs(F.col("lo")[i] - F.col(x)[i]), F.abs(F.col(x)[i] - F.col("hi")[i])) for i in range(dims)]
    return F.sqrt(_sum([d * d for d in far]) * F.col("num") / F.col("den"))


# ---------------------------------------------------------------- the tree

def _boxes(points: DataFrame, dims: int) -> DataFrame:
    sides = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(dims)]
    named = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("copies"), *[s.alias(f"s{i}") for i, s in enumerate(sides)])
    return named.select("node", "n", "copies", F.array(*[F.col(f"s{i}") for i in range(dims)]).alias("lo"),
                        F.array(*[F.col(f"s{i}") for i in range(dims, 2 * dims)]).alias("hi"))


def build_tree(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame, int]:
    """``(leaves, nodes, depth)``: the points with their leaf as ``node``, and
    ``node, parent, leaf, copies, lo, hi`` of every node.  The root of a space
    is the node of its name."""
    live = written(points.withColumn("node", F.col("space")), "points")
    boxes = written(_boxes(live, dims), "boxes")
    nodes, leaves, depth = boxes.withColumn("parent", F.lit(None).cast("string")), None, 0
    while True:
        done = live.join(boxes.where(F.col("n") <= LEAF).select("node"), "node", "left_semi")
        leaves = done if leaves is None else leaves.union(done)
        wide = F.zip_with("hi", "lo", lambda h, low: h - low)
        big = boxes.where(F.col("n") > LEAF).select("node", "n", "lo", "hi", (F.array_position(wide, F.array_max(wide)) - 1).cast("int").alias("dim"))
        if big.isEmpty():
            return leaves, nodes.withColumn("leaf", F.col("n") <= LEAF).drop("n"), depth
        depth += 1
        cut = live.join(big, "node")
        here = F.get("x", F.col("dim"))
        parts = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
        every = F.when(F.col("n") > LEAF * FAN // 2, F.lit(1)).when(F.col("n") > LEAF * FAN // 4, F.lit(2)).otherwise(F.lit(FAN // 2))
        ranks = cut.groupBy("node", "n").agg(F.percentile_approx(here, parts, F.lit(2000)).alias("cuts"), F.max(here).alias("top"), F.min(here).alias("low"))
        ranks = ranks.withColumn("cuts", F.filter("cuts", lambda _, i: (i + 1) % every == 0))
        # a cut is the greatest value of its slice, so one at the top would leave nothing beyond it
        inner = F.array_distinct(F.filter("cuts", lambda v: v < F.col("top")))
        cuts = written(ranks.select("node", F.when(F.size(inner) > 0, inner).otherwise(F.array(F.col("low") / 2 + F.col("top") / 2)).alias("cuts")), "cuts")
        slices = cut.join(cuts, "node").withColumn("child", F.concat_ws("/", "node", F.size(F.filter("cuts", lambda v: v < here)).cast("string")))
        live = written(slices.withColumn("node", F.col("child")).select(live.columns), "points")
        boxes = written(_boxes(live, dims), "boxes")
        nodes = nodes.unionByName(boxes.withColumn("parent", F.regexp_replace("node", "/[^/]*$", "")))


# ---------------------------------------------------------------- the search

def _visit(pairs: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """The best points of their leaf for each ``qid, node, x, num, den, skip, bound``."""
    names = ["qid", "pid", "dist", "m", "load"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
        return flat.reshape(len(column), -1)

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            q, p = matrix(left["x"]), matrix(right["x"])
            pid, m = right["pid"].to_numpy(), right["m"].to_numpy()
            skip, bound = left["skip"].to_numpy(), left["bound"].to_numpy()
            qid, load = left["qid"].to_numpy(), right["load"].to_pylist()
            num, den = (left[c].to_numpy()[:, None] for c in ("num", "den"))
            for at in range(0, len(q), 256):
                total = np.zeros((min(256, len(q) - at), len(p)))
                for j in range(p.shape[1]):
                    d = q[at:at + 256, j, None] - p[None, :, j]
                    total += d * d
                dist = np.sqrt(total * num[at:at + 256] / den[at:at + 256])
                for i in range(len(dist)):
                    row, copies = dist[i], m - (pid == skip[at + i])
                    near = np.flatnonzero((copies > 0) & (row <= bound[at + i]))
                    if len(near) > k:       # each has a copy or more, so those beyond the k-th distance can't count
                        near = near[row[near] <= np.partition(row[near], k - 1)[k - 1]]
                    near, have = near[np.lexsort((pid[near], row[near]))], 0
                    for j in near.tolist():
                        if have >= k:
                            break
                        out.append((int(qid[at + i]), int(pid[j]), float(row[j]), int(copies[j]), load[j]))
                        have += int(copies[j])
        columns = list(zip(*out)) if out else [[] for _ in names]
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    parts = written(pairs.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    left = pairs.join(parts, "node").select("node", "qid", "x", "num", "den", F.coalesce("skip", F.lit(-1).cast("long")).alias("skip"), "bound",
                                            F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"))
    right = leaves.join(parts, "node").select("node", "pid", "x", "m", "load", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(
        best, "qid long, pid long, dist double, m long, load array<double>")


def _cut(found: DataFrame, k: int) -> DataFrame:
    """The first of each query's points, by distance and id, that make up ``k`` copies."""
    order = Window.partitionBy("qid").orderBy("dist", "pid").rowsBetween(Window.unboundedPreceding, -1)
    before = found.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0)))
    return before.where(F.col("before") < k).withColumn("take", F.least(F.col("m"), F.lit(k) - F.col("before")))


def nearest(queries: DataFrame, points: DataFrame, dims: int, k: int, pairs_out: list[int] | None = None) -> DataFrame:
    """Exact k nearest points of every query.

    ``queries``: ``qid`` (not negative), ``space``, ``x`` (array of ``dims``
    doubles), ``skip`` (the pid that gives up one copy, or NULL), and where
    distances are weighted ``num`` and ``den``: a distance is the square root of
    the squares' sum times ``num / den``.
    ``points``: ``space``, ``pid`` (not negative), ``x``, ``m``, ``load``
    (any doubles that go with the point).

    Returns ``qid, pid, dist, take, before, load``: in order of distance, then
    id, a query's points cover neighbours ``before .. before + take - 1``; the
    takes add up to k, or to all copies there are.  ``pairs_out`` gets the number
    of pairs of a query and a leaf that were visited.
    """
    leaves, nodes, depth = build_tree(points.select("space", F.col("pid").cast("long").alias("pid"), "x", F.col("m").cast("long").alias("m"), "load"), dims)
    weights = [F.col(c) if c in queries.columns else F.lit(1.0).alias(c) for c in ("num", "den")]
    asked = written(queries.select(F.col("qid").cast("long").alias("qid"), "space", "x", *weights, F.col("skip").cast("long").alias("skip")), "queries")
    roots = nodes.where("parent IS NULL").select(F.col("node").alias("space"), F.col("node"), "leaf", "copies", "lo", "hi")
    children = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("node").alias("child"), "leaf", "copies", "lo", "hi")
    far = F.when(F.col("copies") > k, corner_distance("x", dims)).otherwise(F.lit(float("inf")))      # one copy may be the query's own
    start = written(asked.join(roots, "space").select("qid", "node", "leaf", "x", "num", "den", "skip", far.alias("most"), box_distance("x", dims).alias("near")), "start")

    home = start.drop("near")
    for _ in range(depth):
        down = home.where("NOT leaf").drop("leaf").join(children, "node").select(
            "qid", F.col("node").alias("of"), F.struct(box_distance("x", dims).alias("near"), "child", "leaf").alias("to"), "x", "num", "den", "skip", F.least("most", far).alias("most"))
        step = down.groupBy("qid", "of").agg(F.min("to").alias("to"), F.min("most").alias("most"), *[F.first(c).alias(c) for c in ("x", "num", "den", "skip")])
        home = written(home.where("leaf").unionByName(step.select(
            "qid", F.col("to.child").alias("node"), F.col("to.leaf").alias("leaf"), "x", "num", "den", "skip", "most")), "home")
    most = home.groupBy("qid").agg(F.min("most").alias("bound"))
    at_home = home.join(most, "qid").drop("leaf", "most")
    first = written(_visit(at_home, leaves, k), "hits")
    kth = _cut(first, k).groupBy("qid").agg(F.sum("take").alias("got"), F.max("dist").alias("kth"))
    bound = written(most.join(kth, "qid", "left").select("qid", F.when(F.col("got") >= k, F.least("kth", "bound")).otherwise(F.col("bound")).alias("bound")), "bound")

    front = start.join(bound, "qid").where("near <= bound").drop("near", "most")
    reached = front.where("leaf")
    for _ in range(depth):
        front = written(front.where("NOT leaf").drop("leaf").join(children, "node").where(box_distance("x", dims) <= F.col("bound")).select(
            "qid", F.col("child").alias("node"), "leaf", "x", "num", "den", "skip", "bound").select(front.columns), "front")
        reached = reached.unionByName(front.where("leaf"))
    rest = reached.drop("leaf").join(home.select("qid", "node"), ["qid", "node"], "left_anti")
    if pairs_out is not None:
        pairs_out.append(home.count() + rest.count())
    found = first.union(_visit(rest, leaves, k))
    return _cut(found, k).select("qid", "pid", "dist", "take", "before", "load")


def expand_neighbours(knn: DataFrame) -> DataFrame:
    """``qid, pid, dist, load, nn_idx, slot``: a row per neighbour 0..k-1; ``slot``
    counts the neighbours that one point gives."""
    one = knn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("slot"))
    return one.select("qid", "pid", "dist", "load", (F.col("before") + F.col("slot")).alias("nn_idx"), "slot")


def grid_knn(q: DataFrame, p: DataFrame, dims: Sequence[str], k: int, exclude_self: bool = False) -> DataFrame:
    """``nearest`` for tables with a column per dimension, all in one space:
    ``q`` (qid, dims...) and ``p`` (pid, dims..., m).  With ``exclude_self`` a
    query gives up one copy of the point that has its number."""
    at = F.array(*[F.col(d).cast("double") for d in dims])
    space, skip = F.lit("all").alias("space"), F.col("qid") if exclude_self else F.lit(None).cast("long")
    return nearest(q.select("qid", space, at.alias("x"), skip.alias("skip")),
                   p.select("pid", space, at.alias("x"), "m", F.array().cast("array<double>").alias("load")), len(dims), k)
