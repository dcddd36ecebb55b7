"""Periodic runs of words: seeds on diagonals, extended to maximal stretches.

A run is a stretch of words with smallest period q whose length is at least
``max(MIN_LENGTH, MIN_PERIODS * q)`` and that no neighbouring word extends.  Its
words agree with those q places further on over length - q places, so a run of
a lag from 2^j to 2^(j+1) - 1 holds, q places apart, two occurrences of one
k-gram with ``k = 3 * 2^j`` (5 for lag 1): the least overlap that such a run
guarantees.  k-grams are named exactly by pairs of names of half their length,
and only places whose shorter name occurs again are named further.

As k is at least 1.5 q, an occurrence of the k-gram nearer than q would give the
run a smaller period, so within a run the next occurrence is q places on, and
the pairs of successive occurrences are all the seeds that are needed: at most
one a word and class of lags.  A pair opens the diagonal of its lag, which is
followed both ways to the first words that differ.  A table of the furthest
place covered on each lag skips the other seeds of the same stretch.

Documents are worked on one by one in Arrow tasks; nothing is shuffled.

Defined cases: a NULL or empty text has no words and no runs; ``doc_id`` may be
NULL or repeated, each row counts for itself; a text of any length is taken
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_PERIODS = 4

Words = list[bytes]
Run = tuple[int, int, int]          # start, length, period


class _Numbers(dict):
    """A number for each word seen by this worker since the last clearing."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_numbers = _Numbers()


def word_numbers(words: Words) -> np.ndarray:
    if len(_numbers) > 300_000:
        _numbers.clear()
    return np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))


def _again(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair of names occurs twice or more, and the pairs' names there."""
    _, name, n = np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True, return_counts=True)
    more = n[name] > 1
    return at[more], name[more]


def seeds(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each class of lags ``k`` and the places and lags of the successive
    occurrences of a k-gram whose lag is in the class."""
    n = len(ids)
    _, name, count = np.unique(ids, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[name] > 1)
    half, size = np.full(n + 1, -1, np.int64), 1        # names of the grams of `size` words that occur again
    half[at] = name[at]

    def named(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Of places with a name, those that with the name `step` words on form a gram that occurs again."""
        at = at[at + step < n]
        at = at[half[at + step] >= 0]
        return _again(at, half[at], half[at + step])

    def successive(at: np.ndarray, name: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(name, kind="stable")
        place, name = at[order], name[order]
        lag = np.where(name[1:] == name[:-1], place[1:] - place[:-1], 0)
        fits = (lag >= low) & (lag < 2 * low)
        return place[:-1][fits], lag[fits]

    low = 1
    while len(at) and MIN_PERIODS * low <= n:
        while size < (4 if low == 1 else 2 * low) and len(at):
            at, name = named(at, size)
            size *= 2
            half[:] = -1
            half[at] = name
        step = 1 if low == 1 else low
        yield size + step, *successive(*named(at, step), low)
        low *= 2


def _follow(ids: np.ndarray, at: int, lag: int, sign: int) -> int:
    """How many words from ``at`` on, in the direction of ``sign``, agree with those ``lag`` further."""
    most = len(ids) - lag - at if sign > 0 else at + 1
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        if sign > 0:
            same = ids[at + done:at + done + step] == ids[at + done + lag:at + done + lag + step]
        else:
            end = at - done + 1
            same = (ids[end - step:end] == ids[end - step + lag:end + lag])[::-1]
        differs = int(np.argmin(same))
        if not same[differs]:
            return done + differs
        done += step
        step *= 2
    return done


def periodic_runs(ids: np.ndarray) -> list[Run]:
    """The runs of the sequence, by start, then period."""
    found: list[Run] = []
    if len(ids) < MIN_LENGTH:
        return found
    for k, places, lags in seeds(ids):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        covered: dict[int, int] = {}
        i = 0
        while i < len(places):
            at, lag = int(places[i]), int(lags[i])
            if at < covered.get(lag, 0):        # on to the lag's first seed beyond what is covered
                last = int(np.searchsorted(lags, lag, side="right"))
                i += int(np.searchsorted(places[i:last], covered[lag]))
                continue
            start = at - _follow(ids, at - 1, lag, -1) if at else 0
            end = at + k + _follow(ids, at + k, lag, 1)
            covered[lag] = end
            if end + lag - start >= max(MIN_LENGTH, MIN_PERIODS * lag):
                found.append((start, end + lag - start, lag))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Words, runs: list[Run]) -> Words:
    """The words without those that some run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """``doc_id, n_words, runs`` (start, length, period) and ``collapsed``, the
    kept words joined by one space, per document.  ``rewrite`` changes the words
    of a document before they are searched."""
    names = ["doc_id", "n_words", "runs", "collapsed"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, runs, kept = batch.column(0).to_pylist(), [], [], []
            for doc, text in zip(ids, batch.column(1)):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(doc, words)
                found = periodic_runs(word_numbers(words))
                size.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(runs, run_type),
                                              pa.array(kept, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones
    the first in the list.  NULL if there is none."""
    def better(best: Column, x: Column) -> Column:
        wide = lambda c: c.cast("decimal(19,0)")
        return F.when(best.isNull() | (wide(x["length"]) * wide(best["period"]) > wide(best["length"]) * wide(x["period"])), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the strongest run and digests of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = strongest(F.col("runs"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
