"""Exact top-k search (11)."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import mtree as M

SCHEMA = "vec_id long, embedding array<{}>, score long, rank int"


def brute(rows, k, every):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(64 * x) for x in v):
            continue
        whole.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(whole):
        if i % every:
            continue
        scores = [(-max(-M.LIMIT, min(M.LIMIT, sum(a * b for a, b in zip(q, x)))), j) for m, (j, x) in enumerate(whole) if m != n and len(x) == len(q)]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def vectors(kind, n, rng):
    if kind == "clusters":
        centres = rng.normal(0, 1, (6, 5))
        return (centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, 5))).tolist()
    if kind == "lognormal":
        return (rng.lognormal(0, 2, (n, 2)) * rng.choice([-1, 1], (n, 2))).tolist()
    some = rng.uniform(-1, 1, (n, 4)).round(1).tolist()         # many ties, and one vector that a third of the rows hold
    return [some[0] if i % 3 == 0 else v for i, v in enumerate(some)]


@pytest.mark.parametrize("kind", ["clusters", "lognormal", "hot"])
def test_search_matches_brute_force(spark, monkeypatch, kind):
    for name, value in (("PAGE", 30), ("FANOUT", 8), ("PART", 50), ("NEXT", 2)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(7)
    rows = [(i * 3 % 500 - 20, v) for i, v in enumerate(vectors(kind, 400, rng))]
    docs = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA.format("double")).repartition(5)
    k = 1 if kind == "lognormal" else 20
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in M.top_products(docs, F.col("vec_id") % 20 == 0, k).collect()]
    assert sorted(got) == brute(rows, k, 20)


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 4)
    random.seed(1)
    odd = [(0, None), (20, []), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (None, [1.0, 2.0]), (100, [-0.0, 0.0]),
           (100, [0.0, 0.0]), (0, [1e-9, -1e-9]), (120, [3e38, -3e38]), (121, [3e38, 1.0]), (140, [1e30, 1e30]), (7, []), (20, [5.0]), (160, [1e300, 1e307])]
    rows = odd + [(i, [random.random(), random.random()]) for i in range(1, 30)] + [(3, [0.5, 0.5])] * 30
    docs = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA.format("double")).repartition(3)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in M.top_products(docs, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == brute(rows, 20, 20)
    assert M.top_products(docs.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []
    alone = spark.createDataFrame([(20, [1.0], 0, 0)], SCHEMA.format("float"))
    assert M.top_products(alone, F.col("vec_id") % 20 == 0, 20).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 10 ** 7):
        x = np.floor(rng.normal(0, scale, (200, 6)))
        q, c = np.floor(rng.normal(0, scale, (30, 6))), x[:1]
        radius, reach = M.norms(x - c).max()[None], M.norms(x).max()[None]
        assert (M.ball_bound(q, q @ c.T, c, radius, reach)[:, 0] >= M.dots(q, x).max(axis=1)).all()


def test_tree_covers_its_points(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 20)
    monkeypatch.setattr(M, "FANOUT", 5)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors("clusters", 700, rng))], "vec_id long, embedding array<double>")
    pages, nodes, depth = M.build_tree(M.distinct_points(M.quantised(docs, 64), 3))
    nodes = {r.node: r for r in nodes.collect()}
    assert depth >= 2 and max(n.depth for n in nodes.values()) == depth
    value = lambda raw: np.frombuffer(raw, "<f4").astype(float)
    held = defaultdict(int)
    for p in pages.collect():
        held[p.node] += 1
        assert nodes[p.node].leaf and abs(np.linalg.norm(value(p.v) - value(nodes[p.node].v)) - p.dist) < 1e-6
        node = nodes[p.node]
        while node.parent:
            assert np.linalg.norm(value(p.v) - value(node.v)) <= node.radius + 1e-6 or not node.leaf
            assert abs(np.linalg.norm(value(node.v) - value(nodes[node.parent].v)) - node.parent_dist) < 1e-6
            node = nodes[node.parent]
    assert max(held.values()) <= 20
