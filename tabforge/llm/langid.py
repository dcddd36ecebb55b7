"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with the
counts of the bytes that followed.  After training the counts are frozen.  The
code length of a byte is found from the longest context: if the context was
seen with the byte, -log2(n(byte) / (n + q)); if it was seen without it, the
escape -log2(q / (n + q)) plus the length in the context one byte shorter; if
it was not seen, that shorter context's length alone.  Here n counts the
context, q the different bytes after it (method C, without exclusion).  Below
order 0 all 256 bytes are alike.  A text's language is the one whose tree gives
it the shortest code.

Training takes up to ``docs_per_language`` labelled documents for each
language (those with the least hash of the id), whole texts, counted by Spark.
Every language is learned.  A model that goes to the tasks has at most
``MODEL_CELLS`` code lengths (or one language); where all languages together
have more, they are cut into groups with a model each, made one at a time.
Each group scores all texts, and an aggregation by the text's digest takes the
least code length over the groups.  Scoring reads whole texts.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0;
without any training text every document is ``und``; equal code lengths go to
the first language in order of name; rows with a NULL language or id train
nothing; repeated rows are scored each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import written

ORDER = 3
DOCS_PER_LANGUAGE = 1000
MODEL_CELLS = 1 << 24    # different grams times languages of one model
BROADCAST_ROWS = 64_000  # ids of training documents that are broadcast whatever their size
CHUNK = 1 << 20          # bytes scored at once; fewer with more than 8 languages
UNDETERMINED = "und"


# ---------------------------------------------------------------- the model

def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """Key of each byte with the ``order`` bytes before it, from position ``order`` on."""
    key = data[:len(data) - order].astype(np.uint64)
    for i in range(1, order + 1):
        key = key << np.uint64(8) | data[i:len(data) - order + i]
    return key


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, size, key, n``: how often each byte string of 1 to order + 1 bytes occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append((text or "").encode("utf-8"))
            for lang, texts in by.items():
                for k in range(order + 1):
                    keys = [gram_keys(np.frombuffer(t, np.uint8), k) for t in texts if len(t) > k]
                    if keys:
                        key, n = np.unique(np.concatenate(keys), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(key)), pa.array(np.full(len(key), k + 1, np.int32)),
                             pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "size", "key", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, size int, key long, n long")
    return counted.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths.  For each gram size the keys seen in any language,
    sorted, and a row of lengths per language; for each context its escape."""

    def __init__(self, languages: list[str], grams: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int):
        self.languages, self.order = languages, order
        n_lang = len(languages)
        self.chunk = min(CHUNK, max(1 << 12, CHUNK * 8 // n_lang))
        base = np.full((1, n_lang), 8.0)                       # every byte alike
        low_keys, low_cost = np.zeros(0, np.uint64), np.zeros((0, n_lang))
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            per_lang = [grams[lang][k] for lang in languages]
            contexts = np.unique(np.concatenate([p[0] >> np.uint64(8) for p in per_lang]))
            keys = np.unique(np.concatenate([p[0] for p in per_lang]))
            escape = np.zeros((len(contexts), n_lang))
            exact = np.full((len(keys), n_lang), np.nan)
            for j, (key, n) in enumerate(per_lang):
                ctx, at, q = np.unique(key >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, n, len(ctx)) + q
                escape[np.searchsorted(contexts, ctx), j] = -np.log2(q / total)
                exact[np.searchsorted(keys, key), j] = -np.log2(n / total[at])
            # what the shorter context says of the same byte, and the way down to it
            lower = self._lower(keys, k, low_keys, low_cost, base)
            down = escape[np.searchsorted(contexts, keys >> np.uint64(8))] + lower
            cost = np.where(np.isnan(exact), down, exact)
            self.keys.append(keys)
            self.cost.append(cost.astype(np.float64))
            self.contexts.append(contexts)
            self.escape.append(escape)
            low_keys, low_cost = keys, cost

    def _lower(self, keys: np.ndarray, k: int, low_keys: np.ndarray, low_cost: np.ndarray, base: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.repeat(base, len(keys), 0)
        short = keys & np.uint64((1 << (8 * k)) - 1)           # every suffix of a gram is a gram
        return low_cost[np.searchsorted(low_keys, short)]

    def lengths(self, key: np.ndarray, k: int) -> np.ndarray:
        """Code length, per language, of the last byte of each key of k context bytes."""
        if k < 0:
            return np.full((len(key), len(self.languages)), 8.0)
        keys, contexts = self.keys[k], self.contexts[k]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = self.cost[k][at]
        miss = np.flatnonzero(keys[at] != key)
        if len(miss):
            some = key[miss]
            ctx = some >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            out[miss] = self.lengths(some & np.uint64((1 << (8 * k)) - 1), k - 1) + self.escape[k][c] * (contexts[c] == ctx)[:, None]
        return out

    def text_bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of a text, per language; memory follows ``chunk``."""
        total = np.zeros(len(self.languages))
        for k in range(min(self.order, len(data))):            # the first bytes have shorter contexts
            total += self.lengths(gram_keys(data[:k + 1], k), k).sum(0)
        for at in range(0, max(0, len(data) - self.order), self.chunk):
            total += self.lengths(gram_keys(data[at:at + self.chunk + self.order], self.order), self.order).sum(0)
        return total

    def batch_bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """``text_bits`` of many short texts by one look-up over their concatenation."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.chunk):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            if end - at == 1:
                out[at] = self.text_bits(part[0])
            else:
                for i, t in enumerate(part):
                    for k in range(min(self.order, len(t))):
                        out[at + i] += self.first_bytes(t[:k + 1].tobytes(), k)
                long = [i for i, t in enumerate(part) if len(t) > self.order]
                if long:
                    keys = [gram_keys(part[i], self.order) for i in long]
                    starts = np.cumsum([0] + [len(x) for x in keys[:-1]])
                    out[[at + i for i in long]] += np.add.reduceat(self.lengths(np.concatenate(keys), self.order), starts, axis=0)
            at = end
        return out

    def first_bytes(self, head: bytes, k: int) -> np.ndarray:
        known = self.__dict__.setdefault("heads", {})
        if head not in known:
            if len(known) > 100_000:
                known.clear()
            known[head] = self.lengths(gram_keys(np.frombuffer(head, np.uint8), k), k)[0]
        return known[head]


def language_groups(sizes: dict[str, int], cells: int) -> list[list[str]]:
    """The languages in order of name, cut where a group's grams times its languages pass ``cells``."""
    groups: list[list[str]] = []
    total = 0
    for name in sorted(sizes):
        total += sizes[name]
        if not groups or total * (len(groups[-1]) + 1) > cells:
            groups.append([])
            total = sizes[name]
        groups[-1].append(name)
    return groups


def train(docs: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | list[Broadcast] | None:
    """A model of all languages from ``doc_id, text, lang`` rows; a list of broadcast
    models where one would be too large; None if no row has text and language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    # a few times as many as are wanted, by the id's hash, so that no task ranks a whole language
    sizes = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    cut = F.lit(2.0 ** 64) * F.lit(8.0 * docs_per_language) / F.col("n") - F.lit(2.0 ** 63)
    some = labelled.select("lang", "doc_id").join(sizes, "lang").where(F.xxhash64("doc_id").cast("double") <= cut).select("lang", "doc_id").distinct()
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = some.withColumn("nth", F.row_number().over(nth))
    chosen = written(chosen.where(F.col("nth") <= docs_per_language).select("lang", "doc_id"), "chosen")
    few = chosen.count() <= BROADCAST_ROWS
    counts = written(count_grams(labelled.join(F.broadcast(chosen) if few else chosen, ["lang", "doc_id"]), order), "grams")
    groups = language_groups({r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}, MODEL_CELLS)
    if len(groups) < 2:
        return _model(counts, groups[0], order) if groups else None
    context = docs.sparkSession.sparkContext
    return [context.broadcast(_model(counts.where(F.col("lang").between(g[0], g[-1])), g, order)) for g in groups]


def _model(counts: DataFrame, languages: list[str], order: int) -> Model:
    table = counts.toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    lang, number = coded.indices.to_numpy(), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
    size = table.column("size").to_numpy()
    key, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64)
    del table, coded
    grams = {}
    for name in languages:
        per = []
        for k in range(order + 1):
            sel = np.flatnonzero((lang == number.get(name, -1)) & (size == k + 1))
            sel = sel[np.argsort(key[sel])]
            per.append((key[sel], n[sel]))
        grams[name] = per
    return Model(languages, grams, order)


# ---------------------------------------------------------------- prediction

def identify(docs: DataFrame, model: Model | list[Broadcast] | None) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``: the share of the best language
    in the likelihoods of all, so 1 when no other comes near."""
    from pyspark.sql import types as T

    if isinstance(model, list):
        return _identify_by_groups(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    tagged = docs.select(F.struct(*[c for c in names if c != "text"]).alias("row") if len(names) > 1 else F.struct(F.lit(0)).alias("row"),
                         F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if m and has_letter(t)]
            if known:
                bits = m.batch_bits([np.frombuffer(texts[i].encode("utf-8"), np.uint8) for i in known])
                best = bits.argmin(1)
                share = 1.0 / np.exp2(np.minimum(0.0, bits.min(1, keepdims=True) - bits)).sum(1)
                for i, b, s in zip(known, best.tolist(), share.tolist()):
                    pred[i], score[i] = m.languages[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score, pa.float64())],
                                             ["row", "text", "lang_pred", "score"])

    schema = T.StructType([*tagged.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return tagged.mapInArrow(run, schema).select(*kept, "lang_pred", "score")


def _identify_by_groups(docs: DataFrame, models: list[Broadcast]) -> DataFrame:
    """``identify`` with a model per group of languages.  Equal texts have one
    result, so a text's digest is its key and only digests and bits are dealt."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    texts = docs.select(F.md5(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))

    def scorer(shared: Broadcast, nth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                rows = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
                if rows:
                    bits = m.batch_bits([np.frombuffer(t.encode("utf-8"), np.uint8) for _, t in rows])
                    least = bits.min(1, keepdims=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in rows]), pa.array([nth] * len(rows), pa.int32()), pa.array(least[:, 0]),
                         pa.array([m.languages[b] for b in bits.argmin(1)]), pa.array(np.exp2(least - bits).sum(1))],
                        ["digest", "nth", "bits", "lang", "weight"])
        return run

    scored = None
    for nth, shared in enumerate(models):
        part = texts.mapInArrow(scorer(shared, nth), "digest string, nth int, bits double, lang string, weight double")
        scored = part if scored is None else scored.unionByName(part)
    once = scored.groupBy("digest", "nth").agg(F.min(F.struct("bits", "lang", "weight")).alias("b"))
    # a digest has as many rows as there are groups
    best = once.groupBy("digest").agg(F.min("b").alias("top"), F.collect_list("b").alias("all")).select(
        "digest", F.col("top.lang").alias("best"), (1.0 / F.aggregate("all", F.lit(0.0), lambda a, x: a + x["weight"] * F.pow(
            F.lit(2.0), F.col("top.bits") - x["bits"]))).alias("share"))
    best = written(best, "best").withColumnsRenamed({"digest": "b_digest", "best": "b_lang", "share": "b_share"})
    joined = docs.select(F.struct(*names).alias("row"), F.md5(F.col("text").cast("string")).alias("digest")).join(
        best, F.col("digest") == F.col("b_digest"), "left")
    kept = [F.col(f"row.`{c}`").cast("string").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*kept, F.coalesce("b_lang", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("b_share", F.lit(0.0)).alias("score"))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by their id's checksum, trains nothing."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))
