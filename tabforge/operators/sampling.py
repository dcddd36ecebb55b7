"""Exact, deterministic sampling by hash rank.

Rows are ordered by ``md5('seed|key1|key2|...')``, then by a hash of the whole
row.  A row whose keys are all NULL (a synthetic one) is ordered by the md5 of
its content, so membership never depends on partitions; rows equal in every
column are interchangeable.

A cut at exact per-class counts (splits, undersampling) needs no shuffle of
rows: counts per class and hash prefix narrow the place of the cut to one short
prefix, whose counts by hash and content give the last row inside, and every row
is compared with that literal.  A mass of equal rows is one count throughout.
Folds need every row's rank: ``hash_rank`` counts it per hash prefix (about 250k
rows each) plus the sizes of the prefixes before, summed up in two levels.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.constants import CV_FOLDS, DEFAULT_SEED, MAX_CLASS_DRIFT
from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col, row_hash

ROWS_PER_BUCKET = 250_000
CUT_ROWS = 100_000       # rows of the last prefix of a class, which one task ranks
PREFIX_STEP = 3          # hex digits by which a prefix grows: 4,096 counts a class


def row_order(df: DataFrame, keys: Sequence[str], seed: int) -> tuple[Column, Column]:
    """The md5 a row is ordered by, and a hash of its content for ties."""
    content = F.xxhash64(*[col(c) for c in sorted(df.columns)])
    if not keys:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), content.cast("string"))), content
    keyless = functools.reduce(lambda x, y: x & y, [col(k).isNull() for k in keys])
    by_content = F.md5(F.concat_ws("|", F.lit(str(seed)), content.cast("string")))
    return F.when(keyless, by_content).otherwise(row_hash(seed, keys)), content


def _prefix_len(n_max: int) -> int:
    if n_max <= ROWS_PER_BUCKET:
        return 1
    return min(8, max(1, math.ceil(math.log(n_max / ROWS_PER_BUCKET, 16)) + 1))


def _offsets(sizes: DataFrame, plen: int) -> DataFrame:
    """Rows before each prefix, in two levels: sums within a leading part of the
    prefix, and of these parts, so that no task orders all prefixes."""
    lead = sizes.withColumn("__p", F.substring("__b", 1, max(1, plen // 2)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = lead.groupBy("__g", "__p").agg(F.sum("__n").alias("__m"))
    tops = tops.select("__g", "__p", F.coalesce(F.sum("__m").over(before(Window.partitionBy("__g").orderBy("__p"))), F.lit(0)).alias("__top"))
    inner = F.coalesce(F.sum("__n").over(before(Window.partitionBy("__g", "__p").orderBy("__b"))), F.lit(0))
    return lead.withColumn("__in", inner).join(tops, ["__g", "__p"]).select("__g", "__b", (F.col("__top") + F.col("__in")).alias("__off"))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int = DEFAULT_SEED, by: str | None = None,
              n_max: int | None = None, rank_col: str = "__rank") -> DataFrame:
    """Add a dense 0-based rank in hash order within each ``by`` group (NULL is one)."""
    h, content = row_order(df, keys, seed)
    grp = F.struct(col(by).cast("string") if by else F.lit(""))
    if n_max is None:
        n_max = df.count()
    plen = _prefix_len(n_max)
    base = df.select("*", h.alias("__h"), content.alias("__x"), grp.alias("__g")).withColumn("__b", F.substring("__h", 1, plen))
    sizes = base.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    offsets = _offsets(sizes, plen)
    ranked = base.join(offsets, ["__g", "__b"])
    wr = Window.partitionBy("__g", "__b").orderBy("__h", "__x")
    return (ranked.withColumn(rank_col, F.col("__off") + F.row_number().over(wr) - 1)
            .drop("__h", "__x", "__g", "__b", "__off"))


Cut = tuple[str, int, int, int]       # hash and content of the last rows inside, how many rows equal them, how many of these are inside


def find_cuts(df: DataFrame, keys: Sequence[str], seed: int, first: Mapping[str | None, int] | Callable[[dict], Mapping[str | None, int]],
              by: str | None = None) -> tuple[dict[str | None, Cut | bool], dict[str | None, int]]:
    """Where the first ``first[class]`` rows of each class end in hash order:
    True for all of a class, False for none, else the cut; and the class sizes,
    from which ``first`` may be computed.

    One pass counts classes and hash prefixes; the prefix that a cut falls in is
    counted further while it holds many rows.  Then rows are counted by hash and
    content, so rows equal in every column are one row here, and the row that each
    class ends with comes to the driver."""
    h, content = row_order(df, keys, seed)
    g = col(by).cast("string") if by else F.lit(None).cast("string")
    base = df.select(g.alias("g"), h.alias("h"), content.alias("x"))
    counts: dict[str | None, dict[str, int]] = {}
    for r in base.groupBy("g", F.substring("h", 1, PREFIX_STEP).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.g, {})[r.p] = r.n
    sizes = {c: sum(v.values()) for c, v in counts.items()}
    want = first(sizes) if callable(first) else first
    ends: dict[str | None, Cut | bool] = {c: want.get(c, 0) >= n for c, n in sizes.items() if want.get(c, 0) <= 0 or want.get(c, 0) >= n}
    open_ = {c: {"prefix": "", "rest": want[c], "n": n} for c, n in sizes.items() if c not in ends}

    def inside() -> Column:
        parts = [F.col("g").eqNullSafe(F.lit(c)) & F.col("h").startswith(o["prefix"]) for c, o in open_.items()]
        return functools.reduce(lambda x, y: x | y, parts)

    def choose() -> None:
        for c, o in open_.items():
            for prefix, n in sorted(counts.get(c, {}).items()):
                if n >= o["rest"]:
                    o.update(prefix=prefix, n=n)
                    break
                o["rest"] -= n

    choose()
    while any(o["n"] > CUT_ROWS and len(o["prefix"]) < 32 for o in open_.values()):
        size = max(len(o["prefix"]) for o in open_.values()) + PREFIX_STEP
        counts = {}
        for r in base.where(inside()).groupBy("g", F.substring("h", 1, size).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r.g, {})[r.p] = r.n
        choose()
    if open_:
        rows = base.where(inside()).groupBy("g", "h", "x").agg(F.count(F.lit(1)).alias("n"))
        upto = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("h", "x")))
        rest = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(c)), o["rest"]) for c, o in open_.items()])
        for r in upto.where((F.col("upto") >= rest) & (F.col("upto") - F.col("n") < rest)).collect():
            ends[r.g] = (r.h, r.x, r.n, open_[r.g]["rest"] - (r.upto - r.n))
    return ends, sizes


def _mark_first(df: DataFrame, keys: Sequence[str], seed: int, first, by: str | None, name: str) -> DataFrame:
    """Add boolean ``name``: among the first rows of the class.

    Every row is compared with the cuts, without a shuffle.  Of rows that are equal
    in every column and that a cut falls between, one is taken and made again
    as often as they are there, some of them inside."""
    ends, _ = find_cuts(df, keys, seed, first, by)
    h, content = row_order(df, keys, seed)
    g = col(by).cast("string") if by else F.lit(None).cast("string")
    inside, shared = F.lit(False), []
    for c, end in ends.items():
        if end is True:
            inside = inside | g.eqNullSafe(F.lit(c))
        elif end is not False:
            hash_, x, n, k = end
            # one comparison, so that a row's md5 is made once
            inside = inside | (g.eqNullSafe(F.lit(c)) & (F.struct(h.alias("h"), content.alias("x")) <= F.struct(F.lit(hash_).alias("h"), F.lit(x).alias("x"))))
            if k < n:
                shared.append((g.eqNullSafe(F.lit(c)) & (h == hash_) & (content == x), n, k))
    if not shared:
        return df.withColumn(name, inside)
    plain = df.where(~functools.reduce(operator.or_, [s[0] for s in shared])).withColumn(name, inside)
    for same, n, k in shared:
        rows = df.where(same)
        other = F.xxhash64(F.lit(1), *[col(c) for c in df.columns])
        if rows.agg(F.min(other) == F.max(other)).first()[0]:
            step = 10_000
            many = rows.limit(1).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(-(-n // step) - 1)))).repartition("__i")
            each = many.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))).withColumn("__j", F.col("__i").cast("long") * step + F.col("__j"))
            made = each.where(F.col("__j") < n).withColumn(name, F.col("__j") < k).drop("__i", "__j")
        else:       # two contents with one hash: so few that they are told apart by their order
            order = Window.partitionBy(F.lit(1)).orderBy(other)
            made = rows.withColumn("__j", F.row_number().over(order)).withColumn(name, F.col("__j") <= k).drop("__j")
        plain = plain.unionByName(made)
    return plain


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    return {r[0]: r[1] for r in df.groupBy(col(target).cast("string")).count().collect()}


def stratified_allocation(counts: dict[str, int], n_draw: int) -> dict[str, int]:
    """Largest-remainder allocation of ``n_draw`` rows over classes (ties by class)."""
    n = sum(counts.values())
    cont = {c: v / n * n_draw for c, v in counts.items()}
    alloc = {c: int(math.floor(x)) for c, x in cont.items()}
    need = n_draw - sum(alloc.values())
    order = sorted(counts, key=lambda c: (-(cont[c] - alloc[c]), c))
    for c in order[:need]:
        alloc[c] += 1
    return alloc


def test_count(n: int, test_size: float) -> int:
    if isinstance(test_size, int) and not isinstance(test_size, bool) and test_size >= 1:
        return int(test_size)
    if not 0 < test_size < 1:
        raise ParamError(f"test_size must be in (0, 1), got {test_size}")
    return int(math.ceil(test_size * n))


def split(df: DataFrame, target: str, keys: Sequence[str], test_size: float = 0.2,
          stratify: bool = False, seed: int = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """Add ``split`` in {'train','test'}; exact sizes, deterministic membership (H5, H6)."""
    def allocate(counts: dict[str | None, int]) -> Mapping[str | None, int]:
        n = sum(counts.values())
        n_train = n - test_count(n, test_size)
        if not 0 < n_train < n:
            raise ParamError(f"Split leaves an empty side: n={n}, test={n - n_train}")
        if not stratify:
            return {None: n_train}
        if None in counts:
            raise DataError("Cannot stratify on a target with nulls.")
        smallest = min(counts.values())
        if smallest < 2:
            raise DataError(f"Cannot stratify: class with only {smallest} sample(s). Distribution: {counts}")
        return stratified_allocation(counts, n_train)

    marked = _mark_first(df, keys, seed, allocate, target if stratify else None, "__first")
    return marked.withColumn(split_col, F.when(F.col("__first"), "train").otherwise("test")).drop("__first")


def kfold(df: DataFrame, target: str, keys: Sequence[str], k: int = CV_FOLDS, seed: int = DEFAULT_SEED,
          fold_col: str = "fold") -> DataFrame:
    """Stratified k-fold id: per-class fold sizes equal those of the usual
    sorted-label round-robin allocation (class c's rows continue the cycle
    where the previous classes stopped).  A class with fewer rows than folds
    is missing in some folds."""
    counts = class_counts(df, target)
    if None in counts:
        raise DataError("Cannot assign folds on a target with nulls.")
    offsets, acc = {}, 0
    for c in sorted(counts):
        offsets[c] = acc
        acc += counts[c]
    ranked = hash_rank(df, keys, seed, by=target, n_max=max(counts.values()))
    off = F.create_map(*[x for c, v in offsets.items() for x in (F.lit(c), F.lit(v))])[col(target).cast("string")]
    return ranked.withColumn(fold_col, ((off + F.col("__rank")) % k).cast("int")).drop("__rank")


def undersample(df: DataFrame, target: str, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Every class cut to the minority count, without replacement (H1).  Rows
    without a class are in no class and are left out."""
    def least(counts: dict[str | None, int]) -> Mapping[str | None, int]:
        classes = {c: n for c, n in counts.items() if c is not None}
        return dict.fromkeys(classes, min(classes.values(), default=0))

    return _mark_first(df, keys, seed, least, target, "__first").where("__first").drop("__first")


def class_drift(df: DataFrame, target: str, split_col: str = "split",
                max_drift: float = MAX_CLASS_DRIFT) -> DataFrame:
    """Per class: train share, test share, |diff| (4 dp) and the over-limit flag.

    One aggregation by class; the share window runs over the class table.
    """
    per = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("target_class")).agg(
        F.count_if(F.col(split_col) == "train").alias("n_train"),
        F.count_if(F.col(split_col) == "test").alias("n_test"))
    w = Window.partitionBy()
    p_tr = F.col("n_train") / F.sum("n_train").over(w)
    p_te = F.col("n_test") / F.sum("n_test").over(w)
    out = per.select("target_class", "n_train", "n_test",
                     F.round(p_tr, 4).alias("train_pct"), F.round(p_te, 4).alias("test_pct"),
                     F.round(F.abs(p_tr - p_te), 4).alias("drift"))
    return out.withColumn("max_drift", F.max("drift").over(w)) \
              .withColumn("exceeds", F.col("max_drift") > F.lit(max_drift))


def require_drift_ok(drift: DataFrame) -> float:
    rows = drift.collect()
    mx = max((r["drift"] for r in rows), default=0.0)
    if rows and rows[0]["exceeds"]:
        raise DataError(f"Class drift {mx:.4f} exceeds limit: "
                        + ", ".join(f"{r['target_class']}={r['drift']}" for r in rows))
    return mx
