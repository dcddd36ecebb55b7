"""Quality selection by importance resampling.

Hashed word 1- and 2-grams make two generative models, of target text (labelled
good and not toxic) and of raw text (all documents).  A document's log weight is the sum over
its grams of ``log((target + PRIOR) / (expected + PRIOR))``, where ``expected``
is the target count if target text were like raw text.  Gumbel noise from a
hash of the row is added, and the ``k`` greatest keys are kept: a sample
without replacement, proportional to the weights.  ``k`` follows the share of
labelled documents that are target text, unless it is given.

The target model is fitted on at most ``TARGET_DOCS`` labelled documents (those
with the least hash of the id); the raw model counts all text.  Both are tables
of 2**``BUCKET_BITS`` counts whatever the input, and so is what goes to the
tasks.  The k-th greatest key is found by counting keys in ever narrower
brackets, never by a sort in one task.

Defined cases: a NULL or empty text has no grams and log weight 0; without
labels all weights are 0 and all documents are kept; a NULL ``doc_id`` has no
label; rows equal in id and text have equal keys and are kept or not together;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import written

BUCKET_BITS = 18
PRIOR = 10.0
TARGET_DOCS = 200_000
SEED = 17
BRACKET = 20_000            # keys that the last bracket may bring to the driver
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Codes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()


def gram_buckets(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of the text's tokens and of its pairs of neighbouring tokens."""
    tokens = _TOKEN.findall((text or "").lower())
    codes = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([codes, pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def count_buckets(marked: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``bucket, target, raw`` over ``text, good``; a task sends each bucket once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = gram_buckets(text, bits)
                np.add.at(raw, at, 1)
                if good:
                    np.add.at(target, at, 1)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    counted = marked.select("text", "good").mapInArrow(run, "bucket long, target long, raw long")
    return counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, bits: int = BUCKET_BITS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket; 0 where there is no text."""
    table = counts.toArrow()
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    at = table.column("bucket").to_numpy()
    target[at], raw[at] = table.column("target").to_numpy(), table.column("raw").to_numpy()
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + prior) / (expected + prior)) if target.any() else np.zeros(1 << bits)


def kth_greatest(keys: DataFrame, k: int) -> tuple | None:
    """The k-th greatest row of ``key, id, mark`` in that order, by counting."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n == 0:
        return None
    if k > n:
        k = n
    above = 0                                   # keys beyond the bracket
    while n > BRACKET and low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).cast("int")
        bins = {r.at: (r.n, r.lo, r.hi) for r in keys.where(F.col("key").between(low, high)).groupBy(at.alias("at")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                n, low, high = bins[b]
                break
            above += bins[b][0]
    if n > BRACKET:                             # one key, or neighbouring ones, many times: no order within
        return (low, None, None)
    rows = keys.where(F.col("key").between(low, high)).select("key", "id", "mark").collect()
    rows.sort(key=lambda r: (r.key, r.id is not None, r.id or 0, r.mark), reverse=True)
    return tuple(rows[k - above - 1])


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, bits: int = BUCKET_BITS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_grams, log_weight, sample_key, kept, text_hash`` per document."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    n_labelled, n_good = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("CAST(quality > 0 AND toxic = 0 AS LONG)")), F.lit(0))).first()
    target = judged.where("quality > 0 AND toxic = 0").orderBy(F.xxhash64("id"), "id").limit(TARGET_DOCS).select("id", F.lit(True).alias("good"))
    marked = rows.join(F.broadcast(target), "id", "left")       # at most TARGET_DOCS ids
    ratios = log_ratios(count_buckets(marked, bits), bits)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_buckets(t, bits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(g) for g in grams], pa.int64()),
                 pa.array([float(shared.value[g].sum()) for g in grams], pa.float64())], ["id", "mark", "n_grams", "log_weight"])

    weighed = rows.mapInArrow(run, "id long, mark long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("id", F.lit(-1)), "mark"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = written(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    total = keyed.count()
    if k is None:
        k = round(total * n_good / n_labelled) if n_labelled else total
    cut = kth_greatest(keyed, k)
    if cut is None:
        kept = F.lit(False)
    else:
        key, doc, mark = cut
        kept = F.col("key") >= F.lit(key)
        if mark is not None:
            same_id = F.col("id").eqNullSafe(F.lit(doc).cast("long"))
            later = (F.col("id") > F.lit(doc).cast("long")) if doc is not None else F.col("id").isNotNull()
            kept = (F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.coalesce(later, F.lit(False)) | (same_id & (F.col("mark") >= F.lit(mark)))))
    return keyed.select(F.col("id").alias("doc_id"), "n_grams", F.round("log_weight", 6).alias("log_weight"),
                        F.round("key", 6).alias("sample_key"), kept.alias("kept"), F.col("mark").alias("text_hash"))
