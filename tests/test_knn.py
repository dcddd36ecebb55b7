"""Adaptive kNN join, kNN imputation with many patterns, SMOTE-NC votes."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import knn
from tabforge.operators.knn_impute import knn_impute
from tabforge.operators.resample import _vote

SCHEMA = "pid bigint, space string, x array<double>, m bigint, load array<double>"


def coordinates(kind, n, rng):
    if kind == "lognormal":
        return rng.lognormal(0, 3, (n, 2))
    if kind == "uniform":
        return rng.uniform(0, 1, (n, 8))
    if kind == "grid":
        return np.unique(rng.integers(0, 9, (n, 3)), axis=0).astype(float)
    return np.column_stack([np.zeros(n), np.where(np.arange(n) < n // 2, 5.0, np.arange(n)), np.arange(n) % 7])     # half of a dimension equal


def brute(rows, k):
    out = {}
    for pid, space, x, _, _ in rows:
        near = []
        for j, other, y, m, _ in rows:
            total = 0.0
            for a, b in zip(x, y):
                total += (a - b) * (a - b)
            if other == space and m - (j == pid) > 0:
                near.append((math.sqrt(total), j, m - (j == pid)))
        got, left = [], k
        for d, j, m in sorted(near):
            if left > 0:
                got.append((j, d, min(m, left), k - left))
                left -= m
        out[pid] = got
    return out


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "grid", "flat"])
def test_nearest_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "LEAF", 20)
    monkeypatch.setattr(knn, "PART", 30)
    rng = np.random.default_rng(4)
    x = coordinates(kind, 300, rng)
    rows = [(i, "ab"[i % 5 == 0], v.tolist(), int(rng.choice([1, 1, 2, 9])), [float(i)]) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, SCHEMA)
    visited = []
    found = knn.nearest(points.select(F.col("pid").alias("qid"), "space", "x", F.col("pid").alias("skip")), points, x.shape[1], 5, visited)
    got = defaultdict(list)
    for r in found.orderBy("qid", "before").collect():
        got[r.qid].append((r.pid, r.dist, r.take, r.before))
        assert r.load == [float(r.pid)]
    assert got == brute(rows, 5)
    if kind == "lognormal":
        assert visited[0] < 6 * len(rows)


def test_nearest_edges(spark):
    points = spark.createDataFrame([(1, "a", [0.0, 0.0], 2, [])], SCHEMA)
    asks = spark.createDataFrame([(0, "a", [3.0, 4.0], None), (1, "a", [0.0, 0.0], 1), (2, "other", [0.0, 0.0], None)], "qid long, space string, x array<double>, skip long")
    assert [(r.qid, r.pid, r.dist, r.take) for r in knn.nearest(asks, points, 2, 5).orderBy("qid").collect()] == [(0, 1, 5.0, 2), (1, 1, 0.0, 1)]
    assert knn.nearest(asks, points.limit(0), 2, 5).collect() == [] and knn.nearest(asks.limit(0), points, 2, 5).collect() == []


def test_knn_impute_with_many_patterns(spark):
    rng = np.random.default_rng(6)
    n, names = 120, ["a", "b", "c", "d"]
    data = np.where(rng.random((n, 4)) < 0.25, np.nan, rng.integers(0, 6, (n, 4)).astype(float))
    data[:30] = data[0]             # repeated rows
    rows = [(i, *[None if math.isnan(v) else v for v in r], i % 2) for i, r in enumerate(data.tolist())]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, t int")
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("impute", "impute")
    out = {r.id: [r[c] for c in names] for r in knn_impute(df, "t", keys=["id"])[0].collect()}
    jobs = tracker.getJobIdsForGroup("impute")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 80           # whatever the patterns are; a loop over them would take hundreds
    order = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in range(n)]
    has = ~np.isnan(data)
    for c in range(4):
        for i in range(n):
            if has[i, c]:
                assert out[i][c] == data[i, c]
                continue
            mine = [j for j in range(4) if j != c and has[i, j]]
            points = defaultdict(list)
            for j in np.flatnonzero(has[:, c]):
                shared = [d for d in mine if has[j, d]]
                if shared:
                    points[tuple(has[j]), tuple(data[j, shared])].append((order[j], data[j, c], math.sqrt(4 / len(shared)), shared))
            near = []
            for members in points.values():
                members.sort()
                _, _, scale, shared = members[0]
                j = order.index(members[0][0])
                dist = math.sqrt(sum((data[i, d] * scale - data[j, d] * scale) ** 2 for d in shared))
                near += [(round(dist, 9), members[0][0], s, m[1]) for s, m in enumerate(members[:5])]
            near.sort()
            want = np.mean([v for *_, v in near[:5]]) if near else np.nanmean(data[:, c])
            assert abs(out[i][c] - want) < 1e-9, (i, c)


def test_vote_takes_the_least_of_the_most_frequent(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0],), ([1.0, 0.0],), ([2.0, 2.0, 1.0, 1.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(_vote(F.col("v"))).collect()] == [1.0, 0.0, 1.0, None]
