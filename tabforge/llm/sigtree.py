"""N-gram Jaccard join with signature trees.

A document's set holds its distinct word 5-grams.  Documents whose Jaccard
similarity is ``THRESHOLD`` or more are linked; the result is the connected
components of the links.

1. Documents with the same set form one class (a 128-bit digest of the set).
2. Two sets that reach the threshold share ``c`` of their first
   ``n - ceil(0.8 n) + c`` shingles in hash order, for any ``c``; here ``c`` is
   the length of the prefix that must hold one.  So a class stays a candidate
   only while at least as many of its first shingles as its smallest possible
   partner must share stand in another candidate's too.  Of the k shingles that
   are left of a class, of which it needs c, the k - c + 1 rarest hold one that
   it has in common with any partner: candidates that share one of these and
   have fitting sizes are joined into groups by star edges, never by pairs.  A
   line or passage that many documents share so makes no group of its own.
3. The texts of a candidate group meet in one tile, where a signature tree
   joins them: a leaf is a class with a bitmap of its shingles, a node the OR
   of its children's bitmaps, their range of sizes and their most shingles
   beyond bits set.  Pairs of nodes are walked level by level and dropped when
   sizes or the most possible overlap rule a link out; of the leaves that
   remain, pairs not yet connected are compared exactly.
4. A group beyond ``TILE`` classes is cut into blocks by size band and hash:
   first each block with itself and with the first block of its own and the
   next band; then, for the classes still outside the group's largest
   component of their band, with all blocks that hold something else.
   So no task holds more than a few blocks, and no link is lost.

Defined cases: a NULL or empty text, or one without words, has an empty set and
is linked with nothing; 1 to 4 words are one shingle; repeated rows are linked
as equal sets are; a NULL ``doc_id`` takes part in links, but is the component
only of rows that no row with an id is linked to; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.components import components
from tabforge.llm.words import window_hashes, words_of
from tabforge.session import drop_written, scratch_tables, written

WORDS = 5
ROUNDS = 6                  # of leaving out classes that lost their partners; fewer or more change no link
TILE = 800                  # classes of a group that are joined in one tile
BLOCK = 400
GROUP_ROWS = 400            # rows of small tiles that one Python call takes
BITS = 4096                 # of a signature
FANOUT = 8


# ---------------------------------------------------------------- sets

def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams (of all its
    words if it has fewer)."""
    words = words_of(text, lower=True)
    return np.unique(window_hashes(words, min(n, len(words))))


def overlap_needed(a: int, b: int) -> int:
    """Least overlap of sets of these sizes with a similarity of 0.8: o >= 0.8 (a + b - o)."""
    return -(-4 * (a + b) // 9)


def common_needed(n: int) -> int:
    """``c`` for a set of n shingles."""
    return n - (4 * n + 4) // 5 + 1


def prefix_length(n: int) -> int:
    """The first so many shingles of linked sets hold ``c`` common ones."""
    return n - (4 * n + 4) // 5 + common_needed(n)


def _needed(n: str = "n") -> Column:
    """``c`` of the smallest set that one of n shingles can be linked with."""
    return F.expr(f"(4 * {n} + 4) div 5 - (4 * ((4 * {n} + 4) div 5) + 4) div 5 + 1")


# ---------------------------------------------------------------- the tree

def signatures(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = (s >> np.uint64(20)) % np.uint64(bits)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class Tree:
    """Levels from the leaves up: bitmaps, least and greatest size, most excess."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        bits = signatures(sets)
        excess = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Can a set under node i and one under node j reach the threshold?
        Their overlap is at most the common bits plus either one's excess."""
        bits, lo, hi, excess = self.levels[level]
        out = (4 * lo[i] <= 5 * hi[j]) & (4 * lo[j] <= 5 * hi[i])
        at = np.flatnonzero(out)
        for part in np.array_split(at, max(1, len(at) // 20_000)):
            a, b = i[part], j[part]
            most = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64) + np.minimum(excess[a], excess[b])
            out[part] = 9 * most >= 4 * (lo[a] + lo[b])
        return out

    def leaf_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that no level rules out, i < j, in parts."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                yield i, j
                continue
            n = len(self.levels[level - 1][1])
            if len(i) > 2_000:
                cut = len(i) // 2
                stack += [(level, i[cut:], j[cut:]), (level, i[:cut], j[:cut])]
                continue
            step = np.arange(FANOUT)
            ci = np.repeat((i[:, None] * FANOUT + step), FANOUT, axis=1).ravel()
            cj = np.tile((j[:, None] * FANOUT + step), (1, FANOUT)).ravel()
            keep = (ci < n) & (cj < n) & ((ci < cj) if level == 1 else (ci <= cj))
            ci, cj = ci[keep], cj[keep]
            keep = self.may_link(level - 1, ci, cj)
            if keep.any():
                stack.append((level - 1, ci[keep], cj[keep]))


def tree_join(sets: list[np.ndarray], given: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects: pairs of positions, one
    for each merge.  ``given`` numbers the components already known."""
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (int(sets[i][0]), len(sets[i])))
    if len(order) < 2:
        return []
    parent = list(range(len(sets)))
    if given is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(g, i) for i, g in enumerate(given)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for left, right in Tree([sets[i] for i in order]).leaf_pairs():
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = order[i], order[j]
            ra, rb = find(a), find(b)
            if ra != rb:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    parent[rb] = ra
                    out.append((a, b))
    return out


# ---------------------------------------------------------------- the Spark job

def read_sets(rows: DataFrame) -> DataFrame:
    """``id, mark, cls, n``: the class and set size of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64())], ["id", "mark", "cls", "n"])

    return rows.mapInArrow(run, "id long, mark long, cls binary, n long")


def prefix_entries(rows: DataFrame) -> DataFrame:
    """``token, node, n``: the first shingles of each class, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                first = s[:prefix_length(len(s))]
                tokens.append(first)
                nodes.append(np.full(len(first), int.from_bytes(digest[:8], "little", signed=True)))
                sizes.append(np.full(len(first), len(s)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)),
                                                  pa.array(np.concatenate(sizes))], ["token", "node", "n"])

    return rows.mapInArrow(run, "token long, node long, n long")


def _in_two(entries: DataFrame) -> DataFrame:
    """Entries whose shingle stands in two classes or more."""
    # dealt by shingle once, for the counts and the join: all columns are used on both sides, so Spark reuses the exchange
    dealt = entries.repartition("token")
    shared = dealt.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("n").alias("n")).where("low != high AND n IS NOT NULL")
    return dealt.join(shared.select("token"), "token").select("token", "node", "n")


def core(entries: DataFrame) -> DataFrame:
    """Entries of the classes that still have enough shingles in common with
    other candidates."""
    first = written(entries, "prefixes")
    now = written(_in_two(first).distinct(), "entries")
    drop_written(first)
    left = now.count()
    for _ in range(ROUNDS):
        # a class has no more entries than its prefix
        keep = now.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("node"))).where(F.col("k") >= _needed()).select("token", "node", "n")
        last, now = now, written(_in_two(keep), "entries")
        drop_written(last)
        before, left = left, now.count()
        if left > 0.9 * before:     # another round costs more than the few entries it would spare the next steps
            break
    return now


def _band(n: Column) -> Column:
    """Sizes of one band, and only of neighbouring bands, can be linked."""
    return F.floor(F.log(n.cast("double")) / math.log(1.25) + 1e-9).cast("int")


def candidate_edges(entries: DataFrame) -> DataFrame:
    """Of each class' shingles the rarest that must hold a common one; star edges
    within a shingle's size band, and one to the band before."""
    counted = entries.join(entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    own = Window.partitionBy("node", "n")
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("k", F.count(F.lit(1)).over(own))
    rare = ranked.where(F.col("rank") <= F.col("k") - _needed() + 1).select("token", "node", "n")
    banded = written(rare.withColumn("band", _band(F.col("n"))), "rare")
    ends = banded.groupBy("token", "band").agg(F.min(F.struct("n", "node")).alias("hub"), F.max(F.struct("n", "node")).alias("last"))
    # a shingle has a row for each size band here, some sixty at most
    told = ends.withColumn("before", F.lag("last").over(Window.partitionBy("token").orderBy("band")))
    stars = banded.join(told.select("token", "band", F.col("hub.node").alias("b")), ["token", "band"]).select(F.col("node").alias("a"), "b")
    line = told.where(F.col("before.n") * 5 >= F.col("hub.n") * 4).select(F.col("hub.node").alias("a"), F.col("before.node").alias("b"))
    return stars.union(line).where("a != b").distinct()


def join_tiles(work: DataFrame) -> DataFrame:
    """Links within tiles.  ``work``: bucket, tile, cls, known, text; rows of a
    tile are in one bucket.  ``known`` is the component a class is in already."""
    def run(group: pa.Table) -> pa.Table:
        tiles: dict[str, list[int]] = {}
        for i, t in enumerate(group.column("tile").to_pylist()):
            tiles.setdefault(t, []).append(i)
        cls, known, texts = (group.column(c).to_pylist() for c in ("cls", "known", "text"))
        a, b = [], []
        for at in tiles.values():
            for i, j in tree_join([shingle_set(texts[i]) for i in at], [known[i] for i in at]):
                a.append(cls[at[i]])
                b.append(cls[at[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return work.groupBy("bucket").applyInArrow(run, "a binary, b binary")


def _text_key(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c, F.lit("")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (least id of the component),
    ``text_hash`` and ``component`` (a key of the component; NULL for an empty
    set) for every row."""
    with scratch_tables(docs.sparkSession) as keep:
        return _components(docs, keep)


def _components(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _text_key(text).alias("mark"), text.alias("text"))
    sets = keep(written(read_sets(rows), "sets"))
    groups = components(candidate_edges(core(prefix_entries(rows))))
    classes = written(sets.where("n > 0").groupBy("cls", "n").agg(F.min(F.struct("id", "mark")).alias("first"), F.min("id").alias("least")), "classes")
    members = written(classes.withColumn("node", _low_long(F.col("cls"))).join(groups, "node").select("cls", "n", "first", "root"), "members")
    links = tile_links(rows, members)
    linked = components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    of_class = classes.join(linked, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = keep(written(of_class.join(least, "comp").select("cls", "comp", "component_id"), "components"))
    return sets.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(found, "cls", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("mark").alias("text_hash"), F.col("comp").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the one with the
    least ``doc_id``, then text hash.  Documents without words all stay."""
    with scratch_tables(docs.sparkSession) as keep:
        found = keep(written(jaccard_components(docs), "near_duplicates"))
    firsts = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(
        F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_mark"), F.lit(True).alias("k_words"))
    empty = found.where("n_shingles = 0").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_mark"), F.lit(False).alias("k_words")).distinct()
    # the document is one column here, so none of its own can have the name of another
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), _text_key(F.col("row.text").cast("string")).alias("mark"))
    joined = rows.join(firsts.union(empty), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark")))
    # of rows equal in id and text one stays; those without words are told apart
    told = joined.withColumn("nth", F.when(F.col("k_words"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    return told.dropDuplicates(["k_id", "k_mark", "nth"]).select("row.*")


def _low_long(cls: Column) -> Column:
    """First 8 bytes of the digest as a little-endian signed long."""
    out = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(cls, i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def tile_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links of all candidate groups.  ``members``: cls, n, first, root."""
    banded = members.withColumn("band", _band(F.col("n")))
    sizes = banded.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = banded.join(sizes, "root")
    small = sized.where(F.col("size") <= TILE).select("cls", "first", F.col("root").cast("string").alias("tile"), F.xxhash64("cls").alias("known"))
    large = written(sized.where(F.col("size") > TILE), "large")
    bands = large.groupBy("root", "band").agg(F.count(F.lit(1)).alias("in_band"))
    blocked = large.join(bands, ["root", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("in_band") / BLOCK)).cast("int")).select("cls", "first", "root", "band", "block")
    # each block with itself, with block 0 of its band and with block 0 of the next; block 0 goes to all of these
    def name(*c: str | Column) -> Column:
        return F.concat_ws("/", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in c])

    blocks = blocked.select("root", "band", "block").distinct()
    own = blocked.select("cls", "first", name("root", "band", "block").alias("tile"))
    hubs = blocked.where("block = 0").select("cls", "first", "root", "band")
    to = blocks.select("root", F.col("band").alias("of"), "block")
    hub_rows = hubs.join(to, "root").where("(of = band AND block > 0) OR of = band - 1").select(
        "cls", "first", name("root", "of", "block", F.when(F.col("of") == F.col("band"), "h").otherwise("n")).alias("tile"))
    with_hub = blocked.select("cls", "first", "root", "band", "block", F.explode(F.array(F.lit("h"), F.lit("n"))).alias("k")).where(
        "k = 'n' OR block > 0").select("cls", "first", name("root", "band", "block", "k").alias("tile"))
    first_round = own.union(hub_rows).union(with_hub).withColumn("known", F.xxhash64("cls"))
    links = written(_run_tiles(rows, small.union(first_round.select(small.columns))), "links")
    if large.limit(1).count() == 0:
        return links
    # what each large group still has outside its band's largest component
    linked = components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    state = written(blocked.join(linked, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "state")
    tally = state.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = tally.groupBy("root").agg(F.max(F.struct("k", "comp")).alias("top")).select("root", F.col("top.comp").alias("main"))
    split = state.join(main, "root").withColumn("rest", F.col("comp") != F.col("main"))
    rest_n = split.where("rest").groupBy("root", "band").agg(F.count(F.lit(1)).alias("in_rest"))
    rest = split.where("rest").join(rest_n, ["root", "band"]).withColumn(
        "rb", F.pmod(F.xxhash64("cls"), F.ceil(F.col("in_rest") / BLOCK)).cast("int"))
    rest = written(rest.select("cls", "first", "root", "band", "comp", "rb"), "rest")
    rest_blocks = rest.select("root", F.col("band").alias("b1"), "rb").distinct()
    every = split.select("cls", "first", "root", "band", "comp", "block")
    all_blocks = every.select("root", F.col("band").alias("b2"), "block").distinct()
    # tiles: a block of the rest with every block of its own and the neighbouring bands
    pairs = rest_blocks.join(all_blocks, "root").where("abs(b1 - b2) <= 1").withColumn("tile", name("root", "b1", "rb", "b2", "block", F.lit("r")))
    side_a = rest.join(pairs.withColumnRenamed("b1", "band"), ["root", "band", "rb"]).select("cls", "first", "tile", F.xxhash64("comp").alias("known"))
    side_b = every.join(pairs.withColumnRenamed("b2", "band"), ["root", "band", "block"]).select("cls", "first", "tile", F.xxhash64("comp").alias("known"))
    more = _run_tiles(rows, side_a.union(side_b).dropDuplicates(["cls", "tile"]))
    return links.union(more)


def _run_tiles(rows: DataFrame, work: DataFrame) -> DataFrame:
    work = written(work, "work")
    buckets = max(1, math.ceil(work.count() / GROUP_ROWS))
    want = work.select("cls", F.col("first.id").alias("w_id"), F.col("first.mark").alias("w_mark")).dropDuplicates(["cls"])
    texts = rows.join(want, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("cls", "text").dropDuplicates(["cls"])
    placed = work.select("cls", "tile", "known").withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
    return join_tiles(placed.join(texts, "cls").select("bucket", "tile", "cls", "known", "text"))
