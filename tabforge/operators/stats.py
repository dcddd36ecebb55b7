"""Column statistics computed on the cluster.

Everything is one pass per statistic family over all requested columns:

* quantiles/median are exact: sketches of all columns, made in one pass, give a
  bracket around each target rank; the few values in it are counted and ranked
  in the cluster, and only the value at the rank reaches the driver.  A bracket
  that would hold many rows is narrowed by sketches of its own first, so no task
  ever holds a whole column (unlike a global ``percentile`` buffer).
* modes, distinct counts and top values come from one tall value-count
  shuffle keyed by (column, value), so a hot value is just one count.
* correlations are pairwise ``covar_pop / (stddev_pop * stddev_pop)`` with
  ``try_divide`` (NULL for constant columns instead of an ANSI error).
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.constants import MAX_CLASSES
from tabforge.errors import DataError
from tabforge.functions.exprs import col, is_numeric_type

ACCURACY = 10_000           # of the sketches that place a bracket: their rank error is a part of 1 / ACCURACY
MAX_BRACKET_VALUES = 1_000_000    # rows expected in a bracket before its values are ranked
QUANTILE_CHUNK = 16         # columns whose sketches one job makes


def tall_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, v) for non-null, non-NaN values of the given numeric columns."""
    wide = df.select(*[col(c).cast("double").alias(c) for c in columns])
    t = wide.unpivot([], list(columns), "name", "v")
    return t.where(F.col("v").isNotNull() & ~F.isnan("v"))


def tall_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, v) for every value (nulls kept) of the given columns, as text."""
    wide = df.select(*[col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot([], list(columns), "name", "v")


# ---------------------------------------------------------------- quantiles
def _interp(lo: float, hi: float, d: float) -> float:
    return lo if d == 0.0 or lo == hi else lo + (hi - lo) * d


def _probes(share: float, margin: float) -> list[float]:
    return [max(0.0, share - margin), min(1.0, share + margin)]


def _value(c: str):
    v = col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _first_brackets(df: DataFrame, columns: list[str], probs: Sequence[float]) -> tuple[dict, list[dict], dict]:
    """Counts per column, a bracket for each rank that is asked for, and the
    ranks and weight of each quantile: sketches of all columns, no shuffle of rows."""
    counts, targets, plan = {}, [], {}
    margin = 2.0 / ACCURACY
    probes = sorted({x for p in probs for x in _probes(float(p), margin)})
    for at in range(0, len(columns), QUANTILE_CHUNK):
        part = columns[at:at + QUANTILE_CHUNK]
        aggs = []
        for i, c in enumerate(part):
            v = _value(c)
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                     F.percentile_approx(v, F.array(*[F.lit(x) for x in probes]), F.lit(ACCURACY)).alias(f"q{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            counts[c], plan[c] = row[f"n{i}"], []
            if not counts[c]:
                continue
            near = dict(zip(probes, row[f"q{i}"]))
            for p in probs:
                h = (counts[c] - 1) * float(p)
                low = int(math.floor(h))
                plan[c].append((low, min(low + 1, counts[c] - 1), h - low))
                for r in plan[c][-1][:2]:
                    below, above = _probes(float(p), margin)
                    if not any(t["name"] == c and t["rank"] == r for t in targets):
                        # one rank more on either side than the sketch's error, or the column's end
                        targets.append({"name": c, "rank": r, "lo": row[f"lo{i}"] if below * counts[c] < 2 else near[below],
                                        "hi": row[f"hi{i}"] if (1 - above) * counts[c] < 2 else near[above],
                                        "least": row[f"lo{i}"], "most": row[f"hi{i}"], "rows": 4 * counts[c] / ACCURACY})
    return counts, targets, plan


def _bracket_table(df: DataFrame, targets: list[dict]) -> DataFrame:
    """A row for each open rank: as many as were asked for, so it may be broadcast."""
    rows = [(i, t["name"], t["rank"], float(t["lo"]), float(t["hi"])) for i, t in enumerate(targets)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "tid int, name string, pos bigint, blo double, bhi double"))


def _narrow(df: DataFrame, tall: DataFrame, targets: list[dict]) -> None:
    """Brackets that hold too many rows are narrowed by sketches of what is in them."""
    inside = tall.join(_bracket_table(df, targets), "name").where(F.col("v") <= F.col("bhi"))
    within = F.when(F.col("v") >= F.col("blo"), F.col("v"))
    sizes = inside.groupBy("tid", "pos").agg(F.count(F.lit(1)).alias("upto"), F.count(within).alias("n"))
    rows = {r.tid: r for r in sizes.collect()}
    shares = []
    for i, t in enumerate(targets):
        r = rows.get(i)
        below = r.upto - r.n if r else 0
        if not r or not below <= t["rank"] < r.upto:        # the sketch missed it: the whole column is its bracket
            t.update(lo=t["least"], hi=t["most"])
            continue
        lower, upper = _probes((t["rank"] - below) / max(r.n - 1, 1), 2.0 / ACCURACY)
        shares.append((i, math.floor(lower * ACCURACY) / ACCURACY, math.ceil(upper * ACCURACY) / ACCURACY))
        t["rows"] = 4 * r.n / ACCURACY
    asked = sorted({x for _, lower, upper in shares for x in (lower, upper)})
    found: dict[int, dict[float, float]] = {}
    for at in range(0, len(asked), 500):
        part = asked[at:at + 500]
        sketch = F.percentile_approx("v", F.array(*[F.lit(x) for x in part]), F.lit(ACCURACY))
        for r in inside.where(F.col("v") >= F.col("blo")).groupBy("tid").agg(sketch.alias("q")).collect():
            found.setdefault(r.tid, {}).update(zip(part, r.q))
    for i, lower, upper in shares:
        targets[i].update(lo=found[i][lower] if lower > 0 else targets[i]["lo"], hi=found[i][upper] if upper < 1 else targets[i]["hi"])


def _ranked(df: DataFrame, targets: list[dict]) -> dict[int, float]:
    """The value at each rank: the rows below a bracket are only counted; distinct
    values in it and their counts are summed up in the cluster, and a row for each
    rank comes back."""
    brackets = list(dict.fromkeys((t["name"], float(t["lo"]), float(t["hi"])) for t in targets))
    columns = list(dict.fromkeys(c for c, _, _ in brackets))
    below: list[int] = []
    for at in range(0, len(brackets), AGG_JOB):
        part = brackets[at:at + AGG_JOB]
        below += df.agg(*[F.count_if(_value(c) < lo).alias(f"b{i}") for i, (c, lo, _) in enumerate(part)]).first()
    near = [F.when(functools.reduce(operator.or_, [_value(c).between(lo, hi) for name, lo, hi in brackets if name == c]), _value(c)) for c in columns]
    places = [str(i) for i in range(len(columns))]
    tall = df.select(*[v.alias(i) for v, i in zip(near, places)]).unpivot([], places, "i", "v").where("v IS NOT NULL")
    spark = df.sparkSession
    # a row for each bracket and for each open rank: as many as were asked for, so they may be broadcast
    bounds = spark.createDataFrame([(k, str(columns.index(c)), lo, hi) for k, (c, lo, hi) in enumerate(brackets)], "bid int, i string, blo double, bhi double")
    counted = tall.join(F.broadcast(bounds), "i").where("v BETWEEN blo AND bhi").groupBy("bid", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("bid").orderBy("v")))
    at = [brackets.index((t["name"], float(t["lo"]), float(t["hi"]))) for t in targets]
    ranks = spark.createDataFrame([(i, k, t["rank"] - below[k]) for i, (t, k) in enumerate(zip(targets, at))], "tid int, bid int, pos bigint")
    found = upto.join(F.broadcast(ranks), "bid").where((F.col("upto") > F.col("pos")) & (F.col("upto") - F.col("n") <= F.col("pos")))
    return {r.tid: r.v for r in found.select("tid", "v").collect()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]
                    ) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles per column (nulls/NaN ignored).

    Returns ``{column: [q(p) for p in probs]}``; None for an all-null column.
    The driver gets as many rows as there are ranks to find, in each job.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    _, targets, plan = _first_brackets(df, columns, probs)
    tall, open_ = tall_numeric(df, columns), targets
    while open_:
        known = [t for t in open_ if t["lo"] == t["hi"] and t["lo"] == t["least"] == t["most"]]
        for t in known:
            t["value"] = t["lo"]
        open_ = [t for t in open_ if "value" not in t]
        for _ in range(8):      # each narrows a bracket by a factor of ACCURACY / 4, unless equal values fill it
            wide = [t for t in open_ if t["rows"] > MAX_BRACKET_VALUES and t["lo"] != t["hi"]]
            if not wide:
                break
            _narrow(df, tall, wide)
        if open_:
            for i, v in _ranked(df, open_).items():
                open_[i]["value"] = v
        open_ = [t for t in open_ if "value" not in t]
        for t in open_:         # a sketch has missed it
            t.update(lo=t["least"], hi=t["most"], rows=0.0)
    value = {(t["name"], t["rank"]): float(t["value"]) for t in targets}
    return {c: [_interp(value[c, a], value[c, b], d) for a, b, d in plan[c]] if plan[c] else [None] * len(probs) for c in columns}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def iqr_fences_stats(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> dict[str, dict]:
    """q1, q3, iqr and fences per column; ``applies`` False when IQR <= 0."""
    qs = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = {"q1": None, "q3": None, "iqr": None, "lower": None, "upper": None, "applies": False}
            continue
        iqr = q3 - q1
        out[c] = {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr,
                  "applies": iqr > 0}
    return out


# ------------------------------------------------------ value counts / mode
def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, v, cnt) over text renderings of the values, nulls included."""
    return tall_text(df, columns).groupBy("name", "v").agg(F.count("*").alias("cnt"))


def value_counts_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return tall_numeric(df, columns).groupBy("name", "v").agg(F.count("*").alias("cnt"))


def modes(df: DataFrame, columns: Sequence[str], numeric: bool) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest value."""
    if not columns:
        return {}
    vc = value_counts_numeric(df, columns) if numeric else value_counts(df, columns)
    vc = vc.where(F.col("v").isNotNull())
    best = vc.groupBy("name").agg(
        F.min_by("v", F.struct((-F.col("cnt")).alias("a"), F.col("v").alias("b"))).alias("mode"))
    got = {r["name"]: r["mode"] for r in best.collect()}
    return {c: got.get(c) for c in columns}


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, salt: int = 64) -> DataFrame:
    """Top-k (value, count) per column, nulls counted; ties by value, null last.

    Two-phase so no window partition holds a whole high-cardinality column:
    top-k inside (column, hash bucket), then top-k over the survivors.
    """
    vc = value_counts(df, columns)
    order = [F.col("cnt").desc(), F.col("v").asc_nulls_last()]
    w1 = Window.partitionBy("name", F.pmod(F.hash("v"), F.lit(salt))).orderBy(*order)
    pre = vc.withColumn("r1", F.row_number().over(w1)).where(F.col("r1") <= k)
    w2 = Window.partitionBy("name").orderBy(*order)
    return (pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .select(F.col("name").alias("column_name"), F.col("v").alias("value"),
                    F.col("cnt").alias("n"), F.col("rank").cast("int").alias("rank")))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nunique non-null, nulls) from the tall value counts."""
    vc = value_counts(df, columns)
    return vc.groupBy(F.col("name").alias("column_name")).agg(
        F.count("v").alias("nunique"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("cnt"))), F.lit(0)).alias("nulls"))


def sorted_categories(df: DataFrame, columns: Sequence[str], max_categories: int | None = None
                      ) -> dict[str, list[str]]:
    """Distinct non-null values per column sorted as text."""
    if not columns:
        return {}
    vc = value_counts(df, columns).where(F.col("v").isNotNull())
    if max_categories is not None:
        too_many = (vc.groupBy("name").count().where(F.col("count") > max_categories).collect())
        if too_many:
            raise DataError("Too many categories to one-hot encode: " + ", ".join(
                f"{r['name']} ({r['count']})" for r in too_many))
    got: dict[str, list[str]] = {c: [] for c in columns}
    for r in vc.select("name", "v").collect():
        got[r["name"]].append(r["v"])
    return {c: sorted(v) for c, v in got.items()}


def label_values(labels: DataFrame, most: int = MAX_CLASSES) -> list[str]:
    """Sorted distinct non-null values of a one-column table of labels.  More than
    ``most`` raise; no more than that come to the driver."""
    name = labels.columns[0]
    rows = labels.select(col(name).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise DataError(f"{name} has more than {most} classes.")
    return sorted(r.v for r in rows)


# ------------------------------------------------------------- correlation
def pearson(a, b):
    """Pearson r as an aggregate expression; NULL when either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


AGG_CHUNK = 48   # moments that are taken as aggregates, not from a matrix
AGG_JOB = 16     # aggregate functions per job: the JVM only interprets the loop that code generation makes of many more


def _run_chunked(df: DataFrame, named: list[tuple[str, object]]) -> dict[str, object]:
    out: dict[str, object] = {}
    for s0 in range(0, len(named), AGG_JOB):
        part = named[s0:s0 + AGG_JOB]
        row = df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(part)]).collect()[0]
        out.update({n: row[f"a{i}"] for i, (n, _) in enumerate(part)})
    return out


def null_flags(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    row = df.agg(*[F.max(col(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(columns)]).collect()[0]
    return {c: bool(row[f"n{i}"]) for i, c in enumerate(columns)}


def _full_corr(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """|r| of all pairs of columns without nulls: one matrix, whose work per row
    is spread over the tasks, so the number of scans doesn't follow the columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    if len(columns) < 2:
        return {}
    names = [f"c{i}" for i in range(len(columns))]
    wide = df.select(*[col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    if wide.isEmpty():
        return {(a, b): None for i, a in enumerate(columns) for b in columns[i + 1:]}
    vectors = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="keep").transform(wide).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return {(a, b): None if math.isnan(matrix[i, j]) else abs(float(matrix[i, j]))
            for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}


def corr_pairs(df: DataFrame, columns: Sequence[str], nulls: dict[str, bool] | None = None
               ) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete |r| for every pair i<j.

    Columns without nulls share one pass, or one correlation matrix where they are
    many; pairs touching a column with nulls are masked to the rows where both are present, in chunks of
    aggregates that fit whole-stage codegen.
    """
    cols = list(columns)
    if len(cols) < 2:
        return {}
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if nulls is None and len(pairs) + 2 * len(cols) <= 2 * AGG_CHUNK:
        # few columns: null flags and all moments in a few passes
        at = {c: i for i, c in enumerate(cols)}
        named = [(f"n{i}", F.max(col(c).isNull().cast("int"))) for c, i in at.items()]
        named += [(f"s{i}", F.stddev_pop(col(c).cast("double"))) for c, i in at.items()]
        named += [(f"c{at[a]}_{at[b]}", F.covar_pop(col(a).cast("double"), col(b).cast("double"))) for a, b in pairs]
        got = _run_chunked(df, named)
        nulls = {c: bool(got[f"n{i}"]) for c, i in at.items()}
        full = {(a, b): _abs_r(got[f"c{at[a]}_{at[b]}"], got[f"s{at[a]}"], got[f"s{at[b]}"]) for a, b in pairs if not nulls[a] and not nulls[b]}
    else:
        nulls = nulls if nulls is not None else null_flags(df, cols)
        full = _full_corr(df, [c for c in cols if not nulls[c]])
    named: list[tuple[str, object]] = []
    for a, b in pairs:
        if nulls[a] or nulls[b]:
            both = col(a).isNotNull() & col(b).isNotNull()
            x, y = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
            named += [(f"cv|{a}|{b}", F.covar_pop(x, y)), (f"sa|{a}|{b}", F.stddev_pop(x)),
                      (f"sb|{a}|{b}", F.stddev_pop(y))]
    got = _run_chunked(df, named)
    return {(a, b): full[(a, b)] if (a, b) in full else _abs_r(got[f"cv|{a}|{b}"], got[f"sa|{a}|{b}"], got[f"sb|{a}|{b}"])
            for a, b in pairs}


def _abs_r(cv, sa, sb):
    if cv is None or sa is None or sb is None or sa == 0 or sb == 0:
        return None
    return abs(cv / (sa * sb))


def target_codes(df: DataFrame, target: str):
    """Target as a number: numeric stays numeric; text gets its sorted-label index."""
    dt = df.schema[target].dataType
    if is_numeric_type(dt):
        return df, col(target).cast("double")
    labels = label_values(df.select(col(target)))
    if not labels:
        return df, F.lit(None).cast("double")
    mapping = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(float(i)))])
    return df, mapping[col(target).cast("string")]


def target_corr(df: DataFrame, features: Sequence[str], target: str) -> dict[str, float | None]:
    """|r| of each feature with the target; NULL if the feature (or target) has any null."""
    if not features:
        return {}
    df, y = target_codes(df, target)
    named: list[tuple[str, object]] = [("sy", F.stddev_pop(y)), ("ny", F.max(y.isNull().cast("int")))]
    for c in features:
        x = col(c).cast("double")
        named += [(f"n|{c}", F.max(col(c).isNull().cast("int"))), (f"sx|{c}", F.stddev_pop(x)),
                  (f"cv|{c}", F.covar_pop(x, y))]
    got = _run_chunked(df, named)
    out = {}
    for c in features:
        if got[f"n|{c}"] or got["ny"]:
            out[c] = None
        else:
            out[c] = _abs_r(got[f"cv|{c}"], got[f"sx|{c}"], got["sy"])
    return out
