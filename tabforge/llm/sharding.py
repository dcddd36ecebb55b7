"""Sharding along a Hilbert curve.

Several metadata dimensions of a document are quantised to ``bits`` bits each
and turned into one index on a Hilbert curve.  Documents are ordered by that
index and the order is cut into runs of equal row count (law ``rows``: counts
differ by one at most), so that a shard covers a compact part of every
dimension and its minima and maxima prune reads by any of them.

All of it is DataFrame expressions.  The rank in the global order is exact: it
is counted per curve cell and tie-hash range, and a hot cell is split by the
hash, so no task ranks more than about ``ROWS_PER_RANGE`` rows of a cell.

Defined cases: a NULL text has size 1 and the checksum of an empty one; NULL
``lang``, ``source`` or ``doc_id`` take coordinate 0; repeated rows are each
placed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import written

SHARDS = 8
BITS = 4
ROWS_PER_RANGE = 50_000


def hilbert_index(coords: Sequence[Column], bits: int) -> Column:
    """Position of a point on the Hilbert curve through ``len(coords)``
    dimensions of ``bits`` bits (as a long; NULL if a coordinate is NULL)."""
    dims = len(coords)
    if dims * bits > 62 or dims < 2 or bits < 1:
        raise ValueError("two or more dimensions and at most 62 bits in all")
    high = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    axes = F.sequence(F.lit(0), F.lit(dims - 1))

    def turn(x: Column, q: Column, i: Column) -> Column:
        """Reflect or exchange the first axis and axis i below bit q."""
        first, other, below = x[0], F.get(x, i), q - F.lit(1)
        swap = first.bitwiseXOR(other).bitwiseAND(below)
        return F.when(other.bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(below)).otherwise(v))
                      ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    planes = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def of(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), f)[0]          # the value is made once, however often f uses it

    def turned(point: Column) -> Column:
        return F.aggregate(high, point, lambda x, q: F.aggregate(axes, x, lambda y, i: turn(y, q, i)))

    def gray(x: Column) -> Column:                        # Gray code along the axes
        return F.transform(axes, lambda i: F.aggregate(F.slice(x, F.lit(1), i + 1), zero, lambda a, v: a.bitwiseXOR(v)))

    def evened(x: Column) -> Column:                      # the parity of the last axis' higher bits goes to all axes
        flip = F.aggregate(high, zero, lambda t, q: F.when(
            F.get(x, F.lit(dims - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - one)).otherwise(t))
        return of(flip, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def woven(x: Column) -> Column:                       # bits of all axes, highest plane first
        return F.aggregate(planes, zero, lambda a, b: F.aggregate(
            x, a, lambda acc, v: acc * 2 + F.call_function("shiftright", v, b).bitwiseAND(one)))

    point = F.array(*[c.cast("long") for c in coords])
    index = of(of(of(of(point, turned), gray), evened), woven)
    return F.when(F.exists(point, lambda v: v.isNull()), F.lit(None)).otherwise(index)


def name_coordinate(name: Column, bits: int) -> Column:
    """Equal names share a coordinate; NULL is 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(name.cast("string"), "utf-8")), F.lit(1 << bits)), F.lit(0))


def size_coordinate(size: Column, bits: int) -> Column:
    """Power of two of a positive size, the last coordinate for all larger ones."""
    return F.least(F.floor(F.log2(size)), F.lit((1 << bits) - 1))


def id_coordinate(doc_id: Column, low: int, high: int, bits: int) -> Column:
    """Equal ranges of ``[low, high]``; NULL is 0."""
    width = float(high) - float(low) + 1.0
    at = F.floor((doc_id.cast("double") - F.lit(float(low))) * F.lit(float(1 << bits)) / F.lit(width))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``: each
    document's shard and its place there along the curve."""
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    point = [name_coordinate(F.col("lang"), bits), name_coordinate(F.col("source"), bits), size_coordinate(F.col("size"), bits),
             id_coordinate(F.col("doc_id"), low or 0, high or 0, bits)]
    rows = written(base.select("doc_id", "size", "text_crc32", hilbert_index(point, bits).alias("curve"),
                               F.xxhash64("doc_id", "text_crc32", "size").alias("tie")), "curve")
    # at most 2**(4 * bits) cells, 65,536 by default
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    total, most = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    split = max(0, math.ceil(math.log2(max(1, most) / ROWS_PER_RANGE)))
    ranged = rows.withColumn("range", F.shiftright("tie", 64 - split) if split else F.lit(0).cast("long"))
    ranges = ranged.groupBy("curve", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    cell_start = cells.select("curve", F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(*earlier)), F.lit(0)).alias("cell_start"))
    in_cell = Window.partitionBy("curve").orderBy("range").rowsBetween(*earlier)
    starts = ranges.join(cell_start, "curve").select(
        "curve", "range", (F.col("cell_start") + F.coalesce(F.sum("n").over(in_cell), F.lit(0))).alias("range_start"))
    place = Window.partitionBy("curve", "range").orderBy("tie", "doc_id", "text_crc32", "size")
    ranked = ranged.withColumn("nth", F.row_number().over(place)).join(starts, ["curve", "range"]).withColumn(
        "rank", F.col("range_start") + F.col("nth") - 1)
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents as one Parquet folder per shard, rows in curve order
    inside files.  Documents meet their place by id, so ids must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Per shard, row count and the least and greatest value of each dimension:
    what a reader needs to skip shards."""
    rows = placed.join(docs.select("doc_id", "lang", "source"), "doc_id")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "size", "lang", "source", "curve") for f in (F.min, F.max)]
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)
