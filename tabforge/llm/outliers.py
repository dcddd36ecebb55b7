"""Quality rules and robust multivariate outliers per language and source.

Counts of each text give base rules and a vector of transformed statistics
(``STATISTICS``).  For each (language, source) the minimum covariance
determinant is estimated over the documents that pass the base rules: from two
deterministic starts (medians with median absolute deviations; means with
covariances) C-steps alternate between the ``SHARE`` of documents with the
least Mahalanobis distance and their mean and covariance, each start of each
group until it comes back to a set it has had, so the number of steps has no
limit but the finite number of sets (6 steps on 10,000 documents); the start with the
lesser determinant counts, followed by one reweighted estimate.  A document is kept if its squared distance is
below the chi-squared cutoff.

All estimates are aggregations of sums that combine before the shuffle, over
all documents; a hot group is one row per task.  Medians and the size of the
nearest share are counted on fine fixed grids, so results don't depend on
partitions.  ``FLOOR`` is the spread that a statistic has in clean text at the
least.  The C-steps, which only look for the nearest documents, add it to their
covariances.  The reweighting and the verdict don't: there it is a lower limit
of the covariance's eigenvalues (in units of ``FLOOR``), so a spread above it
counts as it is and a constant statistic gives no infinite distance.

Small groups: a (language, source) of fewer than ``GROUP_MIN`` passing documents
joins the rest of its language, a rest that small the rest of all; the base
rules alone judge what remains fewer.

Defined cases: a NULL or empty text has no words and fails the base rules; NULL
language or source is a value of its own; repeated rows count and are judged
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.words import window_hashes, words_of
from tabforge.session import written

# FIXED VALUES: the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REPEAT_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20          # per cent of words

SHARE = 0.75
GROUP_MIN = 60
REWEIGHT = 0.975
CUTOFF = 0.999
GRID = 256                  # grid points in a unit of a statistic
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")

#: name: (transformed statistic as SQL over the counts, its least spread)
STATISTICS = {
    "x0": ("ln(1 + n_words)", 0.5),
    "x1": ("ln(word_chars / greatest(n_words, 1))", 0.15),
    "x2": ("ln(1 + 100 * n_symbols / greatest(n_words, 1))", 0.5),
    "x3": ("ln(1 + n_dup_lines)", 0.5),
    "x4": ("ln(1 + 100 * n_repeat_words / greatest(n_words, 1))", 0.6),
    "x5": ("ln(1 + 100 * n_upper / greatest(word_chars, 1))", 0.35),
}
X = list(STATISTICS)
FLOOR = np.array([s[1] for s in STATISTICS.values()])


# ---------------------------------------------------------------- counts

def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``COUNTS`` of one text."""
    text = text or ""
    words = words_of(text)
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeat = 0
    hashes = window_hashes(words, REPEAT_WINDOW)
    if len(hashes):
        _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[at] > 1)
        if len(again):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + REPEAT_WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge)))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat, sum(map(str.isupper, text))


def count_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_counts(t) for t in batch.column(3).to_pylist()]
            cols = zip(*got) if got else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(list(c), pa.int64()) for c in cols],
                                             ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


# ---------------------------------------------------------------- chi-squared, even degrees of freedom

def chi2_cdf(x: float, df: int) -> float:
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def consistency(share: float, df: int) -> float:
    """What a covariance of the nearest share of normal data must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, df), df + 2)


# ---------------------------------------------------------------- estimates

_PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
_EST = "g string, start int, log_det double, n long, mu array<double>, inv array<double>"


def _moments() -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s_{x}") for x in X]
            + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p_{i}_{j}") for i, j in _PAIRS])


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Mean and inverse covariance of each row of ``g, start`` and ``_moments``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mu = np.array([getattr(r, f"s_{x}") for x in X]) / r.n
                cov = np.zeros((len(X), len(X)))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = getattr(r, f"p_{i}_{j}") / r.n - mu[i] * mu[j]
                cov = cov * factor + np.diag(FLOOR ** 2)
                out.append((r.g, r.start, float(np.linalg.slogdet(cov)[1]), int(r.n), mu.tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "start", "log_det", "n", "mu", "inv"])

    return moments.mapInPandas(run, _EST)


def _distance() -> Column:
    """Squared Mahalanobis distance to ``mu`` under ``inv``, at least 0."""
    k = len(X)
    total = F.lit(0.0)
    for i, j in _PAIRS:
        term = (F.col(X[i]) - F.col("mu")[i]) * (F.col(X[j]) - F.col("mu")[j]) * F.col("inv")[i * k + j]
        total = total + (term if i == j else term * 2)
    return F.greatest(total, F.lit(0.0))


def _grid_median(rows: DataFrame, value: str) -> DataFrame:
    """``g, dim, mid``: the median of ``value``, to the nearest grid point."""
    bins = rows.groupBy("g", "dim", F.round(F.col(value) * GRID).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("g", "dim")
    upto = bins.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
    return upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("g", "dim").agg((F.min("bin") / F.lit(float(GRID))).alias("mid"))


def _median_start(vectors: DataFrame) -> DataFrame:
    """Coordinatewise medians and median absolute deviations as a first estimate."""
    tall = vectors.select("g", F.posexplode(F.array(*X)).alias("dim", "x"))
    mid = written(_grid_median(tall, "x"), "medians")
    away = tall.join(mid, ["g", "dim"]).withColumn("away", F.abs(F.col("x") - F.col("mid")))
    both = mid.join(_grid_median(away, "away").withColumnRenamed("mid", "mad"), ["g", "dim"])
    wide = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("dim", "mid", "mad"))).alias("d"))
    floor = F.array(*[F.lit(float(v)) for v in FLOOR])
    var = F.transform("d", lambda r, i: F.pow(r["mad"] * 1.4826, 2) + F.pow(F.get(floor, i), 2))
    k = len(X)
    inv = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.when(i % (k + 1) == 0, 1.0 / F.get(var, F.expr("0") + F.floor(i / k).cast("int"))).otherwise(F.lit(0.0)))
    return wide.select("g", F.lit(0).alias("start"), F.lit(0.0).alias("log_det"), F.lit(0).cast("long").alias("n"), F.col("d.mid").alias("mu"), inv.alias("inv"))


def floor_as_limit(cov: np.ndarray) -> np.ndarray:
    """The covariance with its eigenvalues, in units of ``FLOOR``, at least 1."""
    unit = np.outer(FLOOR, FLOOR)
    values, axes = np.linalg.eigh(cov / unit)
    return (axes * np.maximum(values, 1.0)) @ axes.T * unit


def _limited(estimates: DataFrame) -> DataFrame:
    """``g, mu, inv`` with the added floor taken off again and the floor as lower limit."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = len(X)
            inv = [np.linalg.inv(floor_as_limit(np.linalg.inv(np.array(v).reshape(k, k)) - np.diag(FLOOR ** 2))) for v in f["inv"]]
            yield f.assign(inv=[v.ravel().tolist() for v in inv])

    return estimates.select("g", "mu", "inv").mapInPandas(run, "g string, mu array<double>, inv array<double>")


def fit(vectors: DataFrame, limited: bool = False) -> DataFrame:
    """``g, mu, inv``: the reweighted estimate of each group of ``g, x0, ...``.
    ``limited`` reweights and ends with the floor as a lower limit instead of added."""
    sizes = vectors.groupBy("g").agg(F.ceil(F.count(F.lit(1)) * SHARE).alias("h"))
    sizes = written(sizes, "sizes")
    plain = _estimate(vectors.withColumn("start", F.lit(1)).groupBy("g", "start").agg(*_moments()), 1.0)
    now = written(_median_start(vectors).unionByName(plain), "estimate")
    factor = consistency(SHARE, len(X))
    had, ended, active = None, None, now
    while not active.isEmpty():
        far = vectors.join(active.select("g", "start", "mu", "inv"), "g").select(
            "g", "start", *X, F.floor(F.log2(_distance() + 1e-6) * 64).cast("int").alias("bin"))
        bins = far.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("k"), *_moments())
        upto = F.sum("k").over(Window.partitionBy("g", "start").orderBy("bin"))
        near = bins.withColumn("before", upto - F.col("k")).join(sizes, "g").where(F.col("before") < F.col("h"))
        sums = [F.sum(c).alias(c) for c in ["n", *[f"s_{x}" for x in X], *[f"p_{i}_{j}" for i, j in _PAIRS]]]
        now = written(_estimate(near.groupBy("g", "start").agg(*sums), factor), "estimate")
        # a set is known by its size and the determinant of its covariance
        key = now.select("g", "start", "n", F.round("log_det", 6).alias("d"))
        again = now.limit(0).select("g", "start") if had is None else key.join(had, ["g", "start", "n", "d"], "left_semi").select("g", "start")
        again = written(again, "again")
        done = now.join(again, ["g", "start"], "left_semi")
        ended = done if ended is None else ended.unionByName(done)
        had = key if had is None else had.unionByName(key)
        active = now.join(again, ["g", "start"], "left_anti")
    now = now if ended is None else ended
    best = now.groupBy("g").agg(F.min(F.struct("log_det", "start", "mu", "inv")).alias("b")).select("g", F.col("b.mu").alias("mu"), F.col("b.inv").alias("inv"))
    if limited:
        best = _limited(best)
    inside = vectors.join(best, "g").where(_distance() <= chi2_quantile(REWEIGHT, len(X))).withColumn("start", F.lit(0))
    again = _estimate(inside.groupBy("g", "start").agg(*_moments()), consistency(REWEIGHT, len(X)))
    return _limited(again) if limited else again.select("g", "mu", "inv")


def _group_names(passing: DataFrame) -> DataFrame:
    """``lang, source, g`` for every pair that has a group large enough."""
    n = passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("n") >= GROUP_MIN, F.to_json(F.struct("lang", "source"))).otherwise(F.to_json(F.struct("lang", F.lit("small sources").alias("rest"))))
    first = n.withColumn("g", key)
    per = first.groupBy("g").agg(F.sum("n").alias("in_g"))
    second = first.join(per, "g").withColumn("g", F.when(F.col("in_g") >= GROUP_MIN, F.col("g")).otherwise(F.lit("small languages")))
    last = second.groupBy("g").agg(F.sum("n").alias("all_g"))
    return second.join(last, "g").where(F.col("all_g") >= GROUP_MIN).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g")


def judge_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``distance`` (squared;
    NULL where the base rules decide) of every document."""
    counted = written(count_texts(docs).withColumn("base_failed", base_failed()), "counts")
    passing = counted.where(~F.col("base_failed"))
    groups = written(_group_names(passing), "groups")
    named = passing.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    fitted = written(fit(written(named.select("g", *[F.expr(sql).alias(x) for x, (sql, _) in STATISTICS.items()]), "vectors"), limited=True), "fit")
    of_pair = groups.join(fitted, "g")
    scored = counted.join(of_pair, ~F.col("base_failed") & F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    with_x = scored.select("*", *[F.expr(sql).alias(x) for x, (sql, _) in STATISTICS.items()])
    distance = F.when(F.col("mu").isNotNull(), _distance())
    cutoff = chi2_quantile(CUTOFF, len(X))
    return with_x.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
                         F.round(distance, 6).alias("distance"), "n_upper")
