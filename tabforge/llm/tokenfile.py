"""Token-id files with bit- or byte-plane shuffling.

A file set is a Parquet directory whose rows are segments.  A segment holds
the ids of whole documents in ascending ``doc_id`` order, about
``SEGMENT_IDS`` of them (one longer document makes a longer segment)::

    shard           int     number of the writing task; ascending with doc_id
    start           long    ids of the shard before this segment
    n_ids           long
    doc_ids         array<long>, lengths array<long>   documents, in order
    payload         binary  the ids, in fixed-size blocks of planes

The payload is little-endian: magic ``TFPL``, u8 plane kind (8 byte planes'
bits or 1), u32 ids per block, u32 blocks, then the chunk index (one u32 for
each plane of each block: its compressed size, 0 for a plane of zeros), then
the planes, each a zstandard frame.  The ids of a block are transposed into 4
byte planes or 32 bit planes (most significant last), so the constant high
planes vanish and like bits compress together.  Any block can be read alone
from the index.

Spark's Parquet writer commits the files, so they survive lost executors and
live in any store that Spark writes to.

Defined cases: a NULL text is an empty one (its ids are the end id alone); a
NULL ``doc_id`` sorts first; rows with the same ``doc_id`` are each kept, in
the order of a hash of the text; an empty table writes no segment and reads
back as no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.tokens import default_tokenizer, encoder

BLOCK_IDS = 16_384
SEGMENT_IDS = 1 << 20
MAGIC = b"TFPL"
SEGMENT_FIELDS = "shard int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(rows.T)
    return np.packbits(np.ascontiguousarray(np.unpackbits(rows, axis=1, bitorder="little").T), axis=1, bitorder="little")


def _from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.unpackbits(planes, axis=1, count=n, bitorder="little").T
        return np.ascontiguousarray(np.packbits(rows, axis=1, bitorder="little")).view("<u4").ravel()
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode_payload(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    pack = zstandard.ZstdCompressor(level=level)
    sizes, body = [], []
    for at in range(0, len(ids), block_ids):
        for plane in _to_planes(ids[at:at + block_ids], bits):
            raw = pack.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(raw))
            body.append(raw)
    blocks = -(-len(ids) // block_ids)
    return b"".join([MAGIC, struct.pack("<BII", 1 if bits else 8, block_ids, blocks),
                     np.array(sizes, "<u4").tobytes(), *body])


def decode_payload(payload: bytes, n_ids: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids from ``first`` on; only the blocks that hold them are decompressed."""
    kind, block_ids, blocks = struct.unpack_from("<BII", payload, 4)
    if payload[:4] != MAGIC or kind not in (1, 8):
        raise ValueError("not a token payload")
    bits, planes, head = kind == 1, 32 if kind == 1 else 4, 13
    sizes = np.frombuffer(payload, "<u4", blocks * planes, head).astype(np.int64)
    ends = head + 4 * blocks * planes + np.cumsum(sizes)
    last = n_ids if count is None else min(n_ids, first + count)
    unpack, out = zstandard.ZstdDecompressor(), []
    low = first // block_ids
    for b in range(low, -(-last // block_ids)):
        n = min(block_ids, n_ids - b * block_ids)
        width = -(-n // 8) if bits else n
        got = np.zeros((planes, width), np.uint8)
        for p in range(planes):
            k = b * planes + p
            if sizes[k]:
                got[p] = np.frombuffer(unpack.decompress(payload[ends[k] - sizes[k]:ends[k]], max_output_size=width), np.uint8)
        out.append(_from_planes(got, n, bits))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    return ids[first - low * block_ids:last - low * block_ids]


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None,
                      block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, bits: bool = False) -> None:
    """Encode every text, append ``end_id`` and write the segments to ``path``."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        start, held, docs_in, lengths = 0, [], [], []

        def segment() -> pa.RecordBatch:
            nonlocal start, held, docs_in, lengths
            n = sum(lengths)
            payload = encode_payload(np.frombuffer(b"".join(held), "<u4"), block_ids, bits)
            row = [[shard], [start], [n], [docs_in], [lengths], [payload]]
            start, held, docs_in, lengths = start + n, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        n = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                held.append(ids + end)
                docs_in.append(doc)
                lengths.append(len(ids) // 4 + 1)
                n += lengths[-1]
                if n >= segment_ids:
                    yield segment()
                    n = 0
        if docs_in:
            yield segment()

    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["shard", "start", "n_ids", "doc_ids", "lengths", "payload"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENT_FIELDS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens, ids_crc32`` and, with ``with_ids``, the ids as uint32 ``binary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_payload(row["payload"], row["n_ids"]).tobytes()
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                parts = [raw[4 * s:4 * (s + n)] for s, n in zip(starts.tolist(), row["lengths"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["start"], pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([zlib.crc32(p) for p in parts], pa.int64())] + ([pa.array(parts, pa.binary())] if with_ids else []), names)

    names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    segments = spark.read.schema(SEGMENT_FIELDS).parquet(path)
    docs = segments.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens",
                                            "ids_crc32", *(["ids"] if with_ids else []))
