"""Phrase collocations by mergeable Misra-Gries summaries, then exact counts.

Texts are split into pieces and pieces into words; a gram is 1 to ``MOST`` words
in a row within a piece, counted per language.

1. Each task sums its grams' 64-bit hashes and sends them as sorted blocks to
   hash buckets.  A bucket merges its blocks, some at once, as a Misra-Gries
   summary: beyond ``capacity`` counters the one after the ``capacity`` largest
   is taken off all of them, and what is not above zero goes.  The capacity is
   the bucket's mass divided by the threshold, rounded down, plus one: a gram
   loses at most mass / (capacity + 1), less than the threshold, so each gram
   that reaches the threshold survives with a counter above zero.  What was
   taken off bounds each counter's error, so those that can't reach the
   threshold even with it go.  Equal hashes of different grams only add counts:
   they can't lose a gram either.
2. The survivors mark a bit table, each bucket its own slice, and a second pass
   over the texts counts, exactly and by the grams' own words, those whose bit
   is set.  A bit set for another hash costs a count, never a result.

The number of buckets follows the bytes of the texts, so no task merges more
than a bounded part of the corpus, and a hot gram is one counter in each block.
The bit table's size follows the survivors up to ``MOST_BITS``; beyond that more
grams are counted than need be, with the same result.

Defined cases: a NULL text is empty; a NULL language is ``und``; repeated rows
count each; a word of any length is one word; an empty table gives no rows;
columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import written

MOST = 3                        # words in a phrase
THRESHOLD = 10
TOP = 2000
UNKNOWN = "und"
# FIXED VALUES: what ends a piece; what stands between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

BUCKET_BYTES = 16_000_000       # of text for each hash bucket
MERGED = 1_000_000              # counters of blocks that are merged at once
CHUNK_WORDS = 2_000_000         # words whose grams a task sums at once
MOST_BITS = 28                  # bit table of at most 2^28 bits, 32 MB
SALTS = 32                      # parts of a language that are ranked apart first

_MARK = b"."                    # stands for the ends of pieces; no word can be equal to it
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" ")


def marked_words(text: bytes | None) -> list[bytes]:
    """The text's words, A-Z in lower case, with a mark at each end of a piece."""
    return (text or b"").translate(_TABLE).replace(b"\n", b" . ").split() + [_MARK]


class _Chunk:
    """Words of some texts of one language: dense numbers, and the grams over them."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, xxhash.xxh3_64_intdigest(lang.encode())
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []

    def number(self) -> None:
        index = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        self.ids = np.fromiter(map(index.__getitem__, self.words), np.int64, len(self.words))
        self.known = list(index)
        self.codes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        self.breaks = self.ids == index.get(_MARK, -1)

    def places(self, size: int) -> np.ndarray:
        """Where the grams of ``size`` words begin: no mark among their words."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        broken = np.zeros(n, bool)
        for j in range(size):
            broken |= self.breaks[j:n + j]
        return np.flatnonzero(~broken)

    def hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), (self.seed + size) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        codes = self.codes[self.ids]
        for j in range(size):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """The task's texts as chunks of one language and some ``CHUNK_WORDS`` words."""
    open_: dict[str, _Chunk] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            chunk = open_.setdefault(lang, _Chunk(lang))
            words = marked_words(text.as_py())
            chunk.words += words
            held += len(words)
            if held >= CHUNK_WORDS:
                for chunk in open_.values():
                    chunk.number()
                    yield chunk
                open_, held = {}, 0
    for chunk in open_.values():
        chunk.number()
        yield chunk


def merge_summaries(blocks: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries merge of (distinct hashes, counts): at most ``capacity`` counters,
    and how much was taken off: a hash's true count is its counter's at least,
    and at most that much more.  As many blocks are merged at once as have the counters held so far, and
    ``MERGED`` at least, so the work does not follow the number of blocks."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size, taken = [], 0, 0
    for block in itertools.chain(blocks, [None]):
        if block:
            waiting.append(block)
            size += len(block[0])
            if size < max(MERGED, len(keys)):
                continue
        if not waiting:
            continue
        all_keys = np.concatenate([keys, *(b[0] for b in waiting)])
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        heads = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])[:len(all_keys)])
        sums = np.add.reduceat(np.concatenate([counts, *(b[1] for b in waiting)])[order], heads) if len(heads) else counts
        keys, waiting, size = all_keys[heads], [], 0
        if len(keys) > capacity:
            off = int(np.partition(sums, len(sums) - capacity - 1)[len(sums) - capacity - 1])
            sums, taken = sums - off, taken + off
        keys, counts = keys[sums > 0], sums[sums > 0]
    return keys, counts, taken


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text"))


def summaries(docs: DataFrame, buckets: int, threshold: int = THRESHOLD) -> DataFrame:
    """``bucket, keys`` (little-endian uint64 hashes), a row per bucket: the
    survivors of its Misra-Gries summary, their number ``n`` and its ``mass``."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for size in range(1, MOST + 1):
                keys, counts = np.unique(chunk.hashes(size, chunk.places(size)), return_counts=True)
                cuts = np.searchsorted(keys, _edges(buckets))
                rows = [(b, keys[i:j].tobytes(), counts[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(keys)])) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                                     ["bucket", "keys", "counts"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        # counts of a chunk fit 32 bits; their sum is the bucket's mass
        mass = sum(int(np.frombuffer(c.as_buffer(), "<u4").sum(dtype=np.int64)) for c in group["counts"])
        blocks = ((np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)) for k, c in zip(group["keys"], group["counts"]))
        keys, counts, taken = merge_summaries(blocks, mass // threshold + 1)
        keys = keys[counts + taken >= threshold]        # the others can't have occurred so often
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()),
                         "n": pa.array([len(keys)], pa.int64()), "mass": pa.array([mass], pa.int64())})

    sent = _read(docs).mapInArrow(sums, "bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, n long, mass long")


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket: a bucket is a range of hashes."""
    return np.array([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)


def bit_table(survivors: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the survivors' leading hash bits and how many bits lead.  Bits are
    set in the tasks, and the driver gets no more than the table of fixed size."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    lead = min(MOST_BITS, max(16, (8 * n).bit_length()))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column(0):
                places = np.unique(np.frombuffer(keys.as_buffer(), "<u8") >> np.uint64(64 - lead)).astype(np.int64)
                if not len(places):
                    continue
                first = int(places[0]) // 8
                part = np.zeros((int(places[-1]) // 8 - first + 1) * 8, np.uint8)
                part[places - first * 8] = 1
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["first", "bits"])

    table = np.zeros(1 << (lead - 3), np.uint8)
    for row in survivors.select("keys").mapInArrow(slices, "first long, bits binary").toLocalIterator():
        part = np.frombuffer(row.bits, np.uint8)
        table[row.first:row.first + len(part)] |= part
    return table, lead


def exact_counts(docs: DataFrame, table: np.ndarray, lead: int, threshold: int = THRESHOLD) -> DataFrame:
    """``lang, size, phrase, f`` of the grams that occur ``threshold`` times or more,
    and a row of size 0 with the number of all words per language."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for chunk in chunks(batches):
            langs, sizes, texts, counts = [chunk.lang], [0], [""], [len(chunk.places(1))]
            for size in range(1, MOST + 1):
                at = chunk.places(size)
                lead_bits = (chunk.hashes(size, at) >> np.uint64(64 - lead)).astype(np.int64)
                at = at[(bits[lead_bits >> 3] >> (7 - (lead_bits & 7))) & 1 == 1]
                if not len(at):
                    continue
                # names of the grams, made word by word, so that equal names are equal words
                name = chunk.ids[at]
                for j in range(1, size):
                    _, name = np.unique(name * len(chunk.known) + chunk.ids[at + j], return_inverse=True)
                _, first, n = np.unique(name, return_index=True, return_counts=True)
                for p, k in zip(at[first].tolist(), n.tolist()):
                    langs.append(chunk.lang)
                    sizes.append(size)
                    texts.append(b" ".join(chunk.words[p:p + size]).decode("utf-8", "replace"))
                    counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()),
                                              pa.array(counts, pa.int64())], ["lang", "size", "phrase", "f"])

    counted = _read(docs).mapInArrow(count, "lang string, size int, phrase string, f long")
    sums = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= threshold) | (F.col("size") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """``lang, size, phrase, a, l, r, score`` of the phrases of two words or more,
    at their lowest-scoring cut."""
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "size", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # a <= l and a <= r, so the score is 1,000,000 at most; the products are decimals of 38 digits
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = both.withColumn("score", score).groupBy("lang", "size", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "size", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases."""
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    survivors = written(summaries(docs, max(4, -(-size // BUCKET_BYTES)), threshold), "survivors")
    counts = written(exact_counts(docs, *bit_table(survivors), threshold), "counts")
    phrases = scored(counts)
    # the phrases of one word less at either end of each: a longer one that holds a phrase holds it there, step by step
    inside, parts = None, counts.where("size > 2").select("lang", "size", F.split("phrase", " ").alias("w"), "f")
    for length in range(2, MOST):
        held = parts.where(F.col("size") > length).select("lang", "f", "w", F.explode(F.sequence(F.lit(1), F.col("size") - length + 1)).alias("at")).select(
            "lang", F.array_join(F.slice("w", F.col("at"), F.lit(length)), " ").alias("phrase"), "f")
        inside = held if inside is None else inside.union(held)
    longest = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    kept = phrases.join(longest, ["lang", "phrase"], "left").where(
        "longer is null or cast(100 as decimal(3,0)) * longer < cast(50 as decimal(3,0)) * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each language's phrases in parts first, so that no task ranks more than their tops
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
