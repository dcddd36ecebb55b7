"""Line deduplication over overlapping three-line windows.

A document's lines (cut at ``\\n``) that have a word are numbered, and each
``WIDTH`` consecutive ones make a window; a document with fewer such lines is
one window.  A window that stands anywhere else before (in the order of
``doc_id``, then a hash of the text, then line) is repeated, and the lines that
repeated windows cover, merged, are removed.  A removed line always has an
equal line at an earlier place, and the earliest of them is never removed.

Windows carry a 128-bit hash and the place only; a hash's first place is found
by an aggregation that combines before the shuffle, so a window that stands in
a third of all documents is one row per task.  Hashes that occur once go no
further.

Defined cases: a NULL text stays NULL and an empty one empty; lines without a
word make no window and stay unless every line with a word goes (the text is
then empty); documents with the same ``doc_id`` are told apart by the hash of
their text, and rows equal in both are one place and keep the same lines; a
NULL ``doc_id`` sorts first; an empty table gives no rows; other columns are
kept as they are, those named like a result column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.session import written

WIDTH = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def worded_lines(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the indexes of those with a word."""
    lines = (text or "").split("\n")
    return lines, [i for i, line in enumerate(lines) if _WORD.search(line)]


def window_spans(n: int, width: int) -> list[tuple[int, int]]:
    """Windows over n numbered lines, as (from, to)."""
    return [(i, i + width) for i in range(n - width + 1)] if n >= width else [(0, n)] if n else []


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, copy, text_hash, line, h1, h2`` of every window; ``line`` is
    the number of its first worded line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, at, low, high = [], [], [], [], []
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines, kept = worded_lines(text)
                body = [lines[i] for i in kept]
                for a, b in window_spans(len(body), width):
                    digest = xxhash.xxh3_128_digest("\n".join(body[a:b]).encode("utf-8", "surrogatepass") + bytes([b - a]))
                    ids.append(doc)
                    hashes.append(mark)
                    at.append(a)
                    low.append(int.from_bytes(digest[:8], "little", signed=True))
                    high.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32()),
                                              pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "mark", "line", "h1", "h2"])

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, line int, h1 long, h2 long")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their new text, and ``n_lines`` (lines with a word),
    ``n_removed`` and ``removed`` (their numbers among those lines)."""
    text = F.col("text").cast("string")
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "removed")]
    tagged = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"),
                         F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    found = windows(tagged, width)
    place = F.struct("id", "mark", "line")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("h1", "h2", "first"), "repeated_windows")
    again = found.join(firsts, ["h1", "h2"]).where(place != F.col("first")).groupBy("id", "mark").agg(F.collect_set("line").alias("again"))
    lines = again.select(F.col("id").alias("again_id"), F.col("mark").alias("again_mark"), "again")
    joined = tagged.join(lines, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("mark") == F.col("again_mark")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, gone = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, kept = worded_lines(text)
                drop = sorted({i for s in starts or () for i in range(s, min(s + width, len(kept)))})
                if drop:
                    dropped = {kept[i] for i in drop}
                    text = "" if len(drop) == len(kept) else "\n".join(x for i, x in enumerate(lines) if i not in dropped)
                out.append(text)
                n_lines.append(len(kept))
                gone.append(drop)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()),
                                              pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                                             ["row", "text", "n_lines", "n_removed", "removed"])

    schema = tagged.select("row", "text").schema.add("n_lines", "long").add("n_removed", "long").add("removed", T.ArrayType(T.IntegerType()))
    cut = joined.select("row", "text", "again").mapInArrow(run, schema)
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c in names or c == "text"]
    return cut.select(*kept, "n_lines", "n_removed", "removed")
