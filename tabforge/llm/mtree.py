"""Exact top-k inner products by best-first search of a paged M-tree.

Vectors are compared after quantising (``floor(scale * x)``, whole numbers), by
their inner product; equal vectors are one point with their ``k + 1`` smallest
ids, which is all that a list of ``k`` can show of them.

The tree is built from the top down by joins.  A node of more than ``PAGE``
points picks up to ``FANOUT`` of its points, by hash, as routing objects, and
its points are dealt to the nearest of them, in parts of bounded size however
many points one node holds.  Each child keeps its routing object, its covering
radius, its greatest norm and its distance to the parent's routing object; each
point of a page its distance to the page's.

For a query q and a ball of centre c and radius r, ``<q, x> <= <q, c> + |q| r``,
and as ``d(q, x) >= d(q, c) - r``, also ``2 <q, x> <= |q|^2 + |x|^2 - (d(q, c) - r)^2``.
With the stored distance to the parent's object p, ``<q, c> <= <q, p> + |q| d(c, p)``
rules children out before their product with q is computed, and the stored
distances in a page do so for its points.

A query first visits the page that its nearest routing objects lead to; the
score of its (k + 1)-th point then prunes the walk down the tree.  Of the pages
that are left it visits those with the greatest bounds, ``NEXT`` of them, and
then the ones whose bound still reaches the better score.  All pairs of queries
and nodes are thin rows; queries and points meet in groups of bounded size.

Defined cases: rows with a NULL id, a NULL vector or a component that is NULL,
not finite or beyond the range of doubles once scaled take no part; only
vectors of one length are compared; repeated rows count each, and a query leaves
out one row, its own; scores beyond 64 bits are cut to the largest long; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import written

PAGE = 2048             # points in a page
FANOUT = 64             # routing objects of a node
PART = 16384            # points, or queries, that meet in one group
NEXT = 8                # pages with the greatest bounds that are visited before the rest
SLACK = 1e-6            # of the operands' size: what rounding may add to a bound
LIMIT = 2 ** 63 - 1

POINT = "dim int, v binary, ids array<long>"


# ---------------------------------------------------------------- vectors in tasks

def pack(v: np.ndarray) -> bytes:
    """Whole numbers as float32 where that is exact, else as float64."""
    return v.astype("<f4" if not len(v) or np.abs(v).max() < 2 ** 24 else "<f8").tobytes()


def unpack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim))
    for i, v in enumerate(column):
        raw = v.as_buffer()
        out[i] = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8")
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, cut to 64 bits."""
    top = np.abs(a).max(initial=0) * max(1, a.shape[1])
    easy = np.abs(b).max(axis=1, initial=0) * top < 2 ** 53
    out = np.zeros((len(a), len(b)), np.int64)
    out[:, easy] = (a @ b[easy].T).astype(np.int64)
    if not easy.all():
        whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        out[:, ~easy] = np.clip(whole(a) @ whole(b[~easy]).T, -LIMIT, LIMIT).astype(np.int64)
    return out


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", a, a))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the place of the nearest row of ``c``."""
    top = max(1.0, np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if top * top * max(1, x.shape[1]) < 2 ** 51:        # all sums are exact
        return np.argmin(np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T), axis=1)
    return np.argmin(np.stack([norms(x / top - row) for row in c / top], axis=1), axis=1)


def ball_bound(q: np.ndarray, ip: np.ndarray, center: np.ndarray, radius: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The most ``<q, x>`` may be for x within ``radius`` of ``center`` and of a
    norm up to ``reach``; ``ip`` is ``<q, center>``.  A row per query."""
    qn, cn = norms(q)[:, None], norms(center)[None, :]
    away = np.sqrt(np.maximum(qn ** 2 + cn ** 2 - 2 * ip, 0)) * (1 - SLACK) - radius * (1 + SLACK)
    metric = (qn ** 2 + reach ** 2 - np.maximum(away, 0) ** 2) / 2
    return np.fmin(ip + qn * radius, metric) + SLACK * qn * (cn + radius + reach) + SLACK


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, dim, v, own`` (the vector's product with itself), ``norm`` of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(1)
            sizes, flat = pc.list_value_length(lists).to_pylist(), lists.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)        # NULL becomes NaN
            at = 0
            for i, size in zip(batch.column(0).to_pylist(), sizes):
                if size is None:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(scale * values[at:at + size])
                at += size
                if i is not None and np.isfinite(v).all():
                    v += 0.0            # no negative zero
                    rows.append((i, size, pack(v), int(dots(v[None], v[None])[0, 0]), float(norms(v[None])[0])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64()))],
                                                 ["vec_id", "dim", "v", "own", "norm"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, dim int, v binary, own long, norm double")


# ---------------------------------------------------------------- the tree

def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """``dim, v, norm, ids``: each vector with its ``keep`` smallest ids.  A vector's
    rows are thinned task by task and in parts before they meet."""
    part = F.pmod(F.spark_partition_id(), F.lit(64))
    some = rows.select("dim", "v", "norm", "vec_id", part.alias("part")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("dim", "v", "part").orderBy("vec_id"))).where(F.col("nth") <= keep)
    few = some.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("nth") <= keep)
    return few.groupBy("dim", "v", "norm").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _parts(n: Column) -> Column:
    return F.ceil(n / F.lit(PART)).cast("int")


def build_tree(points: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(pages, nodes, depth)``: ``node, dim, v, ids, dist`` of every point, and
    ``node, parent, depth, dim, v, radius, reach, parent_dist, leaf`` of every
    node.  The roots, one for each length of vectors, have the origin as object."""
    def deal(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return left.slice(0, 0).select(["node", "dim", "v", "ids", "norm", "dist"])
        dim = left["dim"][0].as_py()
        x, c = unpack(left["v"], dim), unpack(right["v"], dim)
        near = nearest(x, c)
        with np.errstate(over="ignore", invalid="ignore"):
            dist = norms(x - c[near])
        child = np.array(right["child"].to_pylist(), object)[near]
        return pa.table({"node": pa.array(child, pa.string()), "dim": left["dim"], "v": left["v"], "ids": left["ids"], "norm": left["norm"], "dist": pa.array(dist)})

    schema = f"node string, {POINT}, norm double, dist double"
    live = written(points.select(F.concat(F.lit("d"), "dim").alias("node"), "dim", "v", "ids", "norm", F.col("norm").alias("dist")), "points")
    stats = written(live.groupBy("node", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("reach")), "nodes")
    origin = F.expr("cast(repeat(chr(0), 4 * dim) as binary)")
    level = stats.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "dim", origin.alias("v"),
                         "radius", "reach", F.lit(0.0).alias("parent_dist"), (F.col("n") <= PAGE).alias("leaf"))
    nodes, pages, depth = level, None, 0
    while True:
        done = live.join(stats.where(F.col("n") <= PAGE).select("node"), "node", "left_semi").select("node", "dim", "v", "ids", "dist")
        pages = done if pages is None else pages.union(done)
        big = stats.where(F.col("n") > PAGE).select("node", "n")
        if big.isEmpty():
            return pages, nodes, depth
        depth += 1
        # routing objects: some points by hash, the least of them; 256 or more are expected, so there are some
        want = F.least(F.lit(FANOUT), F.ceil(F.lit(2.0) * F.col("n") / F.lit(PAGE)))
        spread = F.pmod(F.xxhash64("v", F.lit(depth)), F.lit(1 << 40))
        split = live.join(big, "node")
        picked = split.where(spread < F.lit(float(1 << 40)) * F.greatest(want * 4, F.lit(256)) / F.col("n")).select("node", "v", want.alias("want"), spread.alias("h")).withColumn(
            "nth", F.row_number().over(Window.partitionBy("node").orderBy("h", "v"))).where((F.col("nth") <= FANOUT) & (F.col("nth") <= F.col("want")))
        routing = written(picked.select("node", "v", F.concat_ws("/", "node", F.col("nth").cast("string")).alias("child")), "routing")
        parted = split.withColumn("part", F.pmod(F.xxhash64("v", F.lit(-depth)), _parts(F.col("n"))).cast("int")).drop("n")
        copies = routing.join(big, "node").select("node", "v", "child", F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part"))
        live = written(parted.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInArrow(deal, schema), "points")
        stats = written(live.groupBy("node", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("reach")), "nodes")
        level = _children(routing, stats, level, depth)
        nodes = nodes.union(level)


def _children(routing: DataFrame, stats: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level, with the distances to their parents' objects."""
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, v, u in zip(*(batch.column(c).to_pylist() for c in ("dim", "v", "pv"))):
                both = unpack(pa.chunked_array([pa.array([v, u], pa.binary())]), dim)
                out.append(float(norms(both[:1] - both[1:])[0]))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["pv"]).columns, pa.array(out, pa.float64())],
                                             [c for c in batch.schema.names if c != "pv"] + ["parent_dist"])

    joined = routing.select(F.col("child").alias("node"), F.col("node").alias("parent"), "v").join(stats, "node").join(
        above.select(F.col("node").alias("parent"), F.col("v").alias("pv")), "parent")
    made = joined.select("node", "parent", F.lit(depth).alias("depth"), "dim", "v", "radius", "reach", (F.col("n") <= PAGE).alias("leaf"), "pv").mapInArrow(
        apart, "node string, parent string, depth int, dim int, v binary, radius double, reach double, leaf boolean, parent_dist double")
    return written(made, "level").select("node", "parent", "depth", "dim", "v", "radius", "reach", "parent_dist", "leaf")


# ---------------------------------------------------------------- the search

def meet(pairs: DataFrame, queries: DataFrame, entries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(left, right)`` on the queries of a node's pairs (``q, node`` and
    more) and the node's entries, at most some ``PART`` queries at a time."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right) if len(left) and len(right) else None
        return out if out is not None and len(out) else empty

    empty = pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]])
                      for c in schema.split(",")})
    sizes = pairs.groupBy("node").agg(_parts(F.count(F.lit(1))).alias("parts"))
    left = pairs.join(queries, "q").join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
    right = entries.join(sizes, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(run, schema)


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each query goes to the child with the nearest routing object."""
    dim = left["dim"][0].as_py()
    q, c = unpack(left["v"], dim), unpack(right["v"], dim)
    best = nearest(q, c)
    pick = lambda name: np.array(right[name].to_pylist(), object)[best]
    return pa.table({"q": left["q"], "node": pa.array(pick("child"), pa.string()), "leaf": pa.array(pick("leaf").astype(bool))})


def _open(left: pa.Table, right: pa.Table) -> pa.Table:
    """The children that may hold a point of the queries' least score."""
    dim = left["dim"][0].as_py()
    q, c = unpack(left["v"], dim), unpack(right["v"], dim)
    least, above = left["least"].to_numpy(), left["ip"].to_numpy()
    radius, reach, dist = (right[n].to_numpy() for n in ("radius", "reach", "parent_dist"))
    qn = norms(q)[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        most = above[:, None] + qn * (dist + radius) + SLACK * qn * (dist + radius + reach + norms(c)) + SLACK
        open_ = ~(most < least[:, None])                 # before any product with a child's object
        some = np.flatnonzero(open_.any(axis=0))
        ip = q @ c[some].T
        bound = ball_bound(q, ip, c[some], radius[some], reach[some])
        i, j = np.nonzero(open_[:, some] & ~(bound < least[:, None]))
    col = lambda name: np.array(right[name].to_pylist(), object)[some[j]]
    return pa.table({"q": pa.array(left["q"].to_numpy()[i]), "node": pa.array(col("child"), pa.string()), "leaf": pa.array(col("leaf").astype(bool)),
                     "ip": pa.array(ip[i, j]), "bound": pa.array(bound[i, j])})


def _visit(keep: int) -> Callable:
    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best points of a page for each query, with their ids."""
        dim = left["dim"][0].as_py()
        is_object = np.array(pc.is_null(right["ids"]))
        c = unpack(right["v"].filter(pa.array(is_object)), dim)
        right = right.filter(pa.array(~is_object))
        q, x, dist, least = unpack(left["v"], dim), unpack(right["v"], dim), right["dist"].to_numpy(), left["least"].to_numpy()
        ids, out = right["ids"].to_pylist(), ([], [], [])
        with np.errstate(over="ignore", invalid="ignore"):
            xn = norms(x)
        for at in range(0, len(q), 1024):
            part, floor = q[at:at + 1024], least[at:at + 1024, None]
            with np.errstate(over="ignore", invalid="ignore"):
                ip, qn, cn = part @ c.T, norms(part)[:, None], norms(c)[None, :]
                away = np.abs(np.sqrt(np.maximum(qn ** 2 + cn ** 2 - 2 * ip, 0)) - dist)
                away = np.maximum(away - SLACK * (qn + cn + dist), 0)
                bound = np.fmin(ip + qn * dist, (qn ** 2 + xn ** 2 - away ** 2) / 2) + SLACK * qn * (cn + dist + xn) + SLACK
                near = ~(bound < floor)
            some = np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            score = dots(part, x[some])
            for i, row in enumerate(score):
                cut = np.partition(row, len(row) - keep)[len(row) - keep] if len(row) > keep else row.min()
                best = np.flatnonzero((row >= cut) & (row >= floor[i, 0]))
                found = sorted((-int(row[j]), v) for j in best for v in ids[some[j]])[:keep]
                out[0].extend([left["q"][at + i].as_py()] * len(found))
                out[1].extend(-s for s, _ in found)
                out[2].extend(v for _, v in found)
        return pa.table({"q": pa.array(out[0], pa.int64()), "score": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64())})
    return visit


def best_of(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)


def _least(hits: DataFrame, keep: int, queries: DataFrame) -> DataFrame:
    """The queries with the score of their ``keep``-th best hit so far as ``least``."""
    last = best_of(hits, keep).where(F.col("nth") == keep).select("q", F.col("score").cast("double").alias("least"))
    return queries.drop("least").join(last, "q", "left").withColumn(
        "least", F.coalesce(F.col("least") - F.abs("least") * 1e-15, F.lit(float("-inf"))))


def search(queries: DataFrame, pages: DataFrame, nodes: DataFrame, depth: int, keep: int) -> DataFrame:
    """``q, score, vec_id, nth``: the ``keep`` best of every query (``q, dim, v``)."""
    objects = nodes.where("leaf").select("node", "dim", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(-1.0).alias("dist"))
    entries = pages.union(objects).select("node", "v", "ids", "dist")
    children = nodes.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("child"), "v", "radius", "reach", "parent_dist", "leaf")
    roots = nodes.where("parent is null").select("node", F.col("dim").alias("root_dim"), "leaf")
    start = queries.join(roots, F.col("dim") == F.col("root_dim")).select("q", "node", "leaf")
    visits = _visit(keep)
    hit = "q long,score long,vec_id long"
    asking = queries.withColumn("least", F.lit(float("-inf")))

    home = start
    for _ in range(depth):
        down = meet(home.where("not leaf").select("q", "node"), asking, children, _nearest, "q long,node string,leaf boolean")
        home = written(home.where("leaf").union(down), "home")
    hits = written(meet(home.select("q", "node"), asking, entries, visits, hit), "hits")
    asking = written(_least(hits, keep, queries), "asking")

    wide = "q long,node string,leaf boolean,ip double,bound double"
    front = start.select("*", F.lit(0.0).alias("ip"), F.lit(float("inf")).alias("bound"))
    found = front.where("leaf")
    for _ in range(depth):
        front = written(meet(front.where("not leaf").select("q", "node", "ip"), asking, children, _open, wide), "front")
        found = found.union(front.where("leaf"))
    rest = found.join(home.select("q", "node"), ["q", "node"], "left_anti").select("q", "node", "bound")
    rest = written(rest, "rest")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound")))
    cut = rest.withColumn("nth", nth).where(F.col("nth") <= NEXT).groupBy("q").agg(F.min("bound").alias("cut"))
    rest = written(rest.join(cut, "q"), "rest")
    for now in ("bound >= cut", "bound < cut"):
        left = rest.where(now).join(asking.select("q", "least"), "q").where("bound >= least").select("q", "node")
        hits = hits.union(written(meet(left, asking, entries, visits, hit), "hits"))
        asking = written(_least(hits, keep, queries), "asking")
    return best_of(hits, keep)


def top_products(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id``,
    ``embedding``) that ``queries`` holds for, the ``k`` other rows of the
    greatest inner products, ties to the smaller ``vec_id``."""
    rows = written(quantised(vectors, scale), "quantised")
    pages, nodes, depth = build_tree(distinct_points(rows, k + 1))
    asked = rows.where(queries)
    asking = written(asked.select("dim", "v").distinct().select(F.monotonically_increasing_id().alias("q"), "dim", "v"), "queries")
    best = search(asking, pages, nodes, depth, k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("best"))
    listed = asked.join(asking.join(best, "q").drop("q"), ["dim", "v"]).withColumn(
        "own_at", F.array_position("best", F.struct((-F.col("own")).alias("s"), F.col("vec_id").alias("i"))))
    others = F.filter("best", lambda _, i: i + 1 != F.col("own_at"))
    return listed.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))
