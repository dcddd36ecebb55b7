"""Connected components of an edge table by alternating star operations.

Each round joins every node's neighbours to their least one, first the larger
neighbours, then the smaller ones, until the edges are stars.  A round is two
aggregations (combined before the shuffle) and two joins by node; a hub's rows
are split by the adaptive skew join.  Every round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    stars = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stars.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` edges to ``node, root``: the least node of the component of each
    node that has an edge to another.  Loops and repeated edges do no harm."""
    now = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        last, now = now, written(_small_star(_large_star(now)).where("a != b").distinct(), "edges")
        drop_written(last)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
