"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond
ASCII.  A window is ``window`` consecutive words of a benchmark item; an item of
fewer words is one window.  A document word inside any occurrence of a window
is hit.

Winnowing keeps the least k-gram hash of every ``width`` successive k-grams;
with ``k + width - 1 == window`` each window has one kept hash, the same in a
document and in an item, so two texts that share a window share a kept hash.
Kept hashes of documents and items are joined.  In the documents that share one,
each hit is extended to the windows that it is the kept hash of, and these are
compared whole with the items' windows by two 64-bit hashes of their words, so
all and only true occurrences count.  Items shorter than ``window`` words are
one window, looked up at every position.  The work is a few rows for each word
of a document that shares a hash, however often a word, a hash or a window
stands in it or in the items.

All of it is DataFrame expressions.  Words are hashed and compared with ASCII
lower case: full Unicode lower case depends on what stands around a word.

Defined cases: a NULL or empty text has no words; documents with the same
``doc_id`` are each judged, by a hash of the text; a NULL ``doc_id`` is a
value like any other; items without words never occur; the windows of items
without ``item_id`` count as hits, but such items have no id that could be
listed or counted in ``n_items``; empty tables give no rows or no hits; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import scratch_tables, written

WINDOW = 13
GRAM = 5
# FIXED VALUE: what separates words (ASCII other than digits and letters; upper case is lowered before).
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, NOT_WORDS, -1), lambda w: w != "")


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value made once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _upto(n: Column) -> Column:
    """0 .. n-1 (empty if n < 1)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, k: int) -> Column:
    """Hashes of the k-grams of ``words``."""
    return _once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        _upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) if j else F.get(h, i) for j in range(k)])))


def winnowed(hashes: Column, width: int) -> Column:
    """The least hash of each ``width`` successive ones, each value once.
    Fewer hashes than that give their least one."""
    return _once(hashes, lambda g: F.array_distinct(F.transform(
        _upto(F.greatest(F.size(g) - (width - 1), F.least(F.size(g), F.lit(1)))),
        lambda i: F.least(*[F.get(g, i + j) for j in range(width)]) if width > 1 else F.get(g, i))))


def read_benchmark(benchmark: DataFrame) -> DataFrame:
    """``item_id, item`` (its words, ASCII lower case) of the items that have words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return benchmark.select("item_id", _words(F.translate(text, _UPPER, _LOWER)).alias("item")).where(F.size("item") > 0)


def fingerprints(words: Column, window: int, k: int, short: list[int]) -> Column:
    """Kept hashes of a document; for each short item length all hashes of that length."""
    kept = winnowed(grams(words, k), window - k + 1)
    for n in short:
        kept = F.concat(kept, F.array_distinct(grams(words, n)))
    return kept


def windows(words: Column, window: int, k: int, lengths: list[int]) -> Column:
    """``(n, s, mark, w1, w2)`` of the windows of each length in ``lengths``: where
    they start, their kept hash and two hashes of their words."""
    def of(n: int) -> Column:
        size = k if n >= window else n
        least = lambda g, i: F.least(*[F.get(g, i + j) for j in range(n - size + 1)]) if n > size else F.get(g, i)
        both = lambda h, i: [F.xxhash64(*salt, *[F.get(h, i + j) for j in range(n)]) for salt in ((), (F.lit(n),))]

        def built(h: Column, g: Column) -> Column:
            return F.transform(_upto(F.size(h) - (n - 1)), lambda i: F.struct(
                F.lit(n).alias("n"), i.alias("s"), least(g, i).alias("mark"), both(h, i)[0].alias("w1"), both(h, i)[1].alias("w2")))

        return _once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _once(grams(words, size), lambda g: built(h, g)))

    return F.concat(*[of(n) for n in lengths])


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``(words, hits)``: ``row_key, doc_id, n_words`` of every document, and per
    document with an occurrence ``row_key, n_hit, n_items, items``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # item lengths below the window: at most window - 1 values
    short = sorted(r[0] for r in items.where(F.size("item") < window).select(F.size("item")).distinct().collect())
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h")).alias("row_key"), text.alias("text"))
    marked = rows.select("row_key", _words(F.translate("text", _UPPER, _LOWER)).alias("w")).select(
        "row_key", F.size("w").cast("long").alias("n_words"), fingerprints(F.col("w"), window, k, short).alias("marks"))
    marked = written(marked, "marks")

    lengths = [*short, window]
    of_item = F.filter(windows(F.col("item"), window, k, lengths), lambda x: x["n"] == F.least(F.size("item"), F.lit(window)))
    # written, so that Spark knows its size and broadcasts it only below its threshold; so with the other small tables
    item_windows = written(items.select("item_id", F.explode(of_item).alias("x")).select("item_id", "x.n", "x.mark", "x.w1", "x.w2").distinct(), "item_windows")
    marks = written(item_windows.select("mark").distinct(), "item_marks")
    shapes = written(item_windows.select("n", "w1", "w2").distinct(), "item_shapes")
    suspects = written(marked.select("row_key", F.explode("marks").alias("mark")).join(marks, "mark").select("row_key").distinct(), "suspects")

    # the suspects' windows around the shared hashes, compared whole
    keyed = rows.join(suspects, "row_key").dropDuplicates(["row_key"]).select("row_key", _words(F.translate("text", _UPPER, _LOWER)).alias("w"))
    near = keyed.select("row_key", F.explode(windows(F.col("w"), window, k, lengths)).alias("x")).select("row_key", "x.*").join(marks, "mark", "left_semi")
    found = written(near.join(shapes, ["n", "w1", "w2"], "left_semi").select("row_key", "n", "s", "w1", "w2"), "found")
    n_hit = found.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("spans")).select("row_key", _covered("spans").alias("n_hit"))
    named = found.select("row_key", "n", "w1", "w2").distinct().join(item_windows.where("item_id is not null").drop("mark"), ["n", "w1", "w2"])
    listed = named.select("row_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row_key").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    return marked.select("row_key", "n_words"), n_hit.join(listed, "row_key", "left").select(
        "row_key", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items")


def _covered(spans: str) -> Column:
    """How many positions the spans cover, which come by start."""
    def step(acc: Column, x: Column) -> Column:
        end = x["s"] + x["n"]
        return F.struct(F.greatest(acc["at"], end).alias("at"), (acc["n"] + F.greatest(end - F.greatest(acc["at"], x["s"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row_key`` per
    document: contaminated if a twentieth of its words or more are hit."""
    words, hits = find_hits(docs, read_benchmark(benchmark), window, k)
    joined = words.join(hits, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("row_key.id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.col("row_key.h").alias("text_hash"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    with scratch_tables(docs.sparkSession) as keep:
        bad = keep(written(decontaminate(docs, benchmark, window, k).where("contaminated").select(
            F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated"))
    # the document is one column here, so none of its own can have the name of another
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("mark"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_hash")), "left_anti").select("row.*")
