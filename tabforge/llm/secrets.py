"""Secret scan: three base patterns and sliding-window Shannon entropy.

Base kinds ``assign``, ``access`` and ``hex`` are patterns with a length
condition.  The method adds ``entropy``: within candidate strings (runs of 20
or more base64 or URL-safe characters) a window moves one character at a time;
its character counts are updated by the character that enters and the one that
leaves, and the sum over c * log2(c) with them, so each step gives the
window's entropy without counting anew.  Window and threshold depend on the
candidate's character class; 20 to 23 hexadecimal digits are one window.  The span runs from the first to the last window
at or above the threshold.  Candidates on the allow list (UUIDs, words, paths,
numbers, fields that are all placeholders or words) are suppressed.  Base spans
are cut out of a candidate, and the pieces that are left are candidates of their own.

All of it is DataFrame expressions on one row at a time: no shuffle.  Positions
are code points, ends exclusive.

Defined cases: a NULL or empty text has no spans (``base_sha256`` is that of
an empty string); texts of any length are scanned whole; repeated rows and
NULL ids give a row each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: the base patterns, and the least length of what must be long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

SHORTEST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class: (pattern of the whole candidate, window, least entropy in bits); the first that matches holds
CLASSES = {
    **{f"hex{n}": (r"^[0-9A-Fa-f]{%d}$" % n, n, 2.8) for n in range(20, 24)},
    "hex": (r"^[0-9A-Fa-f]+$", 24, 2.8),
    "alnum": (r"^[A-Za-z0-9]+$", 20, 3.7),
    "base64": (r"^.+$", 20, 3.8),
}
# Loops over groups are possessive: the others recurse once for each repetition, and a long string would end the stack.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",     # UUID
    r"^[0-9+/_=-]+$",                                                                       # numbers, rules
    r"^(?:[A-Z]?[a-z]{2,}+)++$",                                                            # words, also run together
    r"^(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)[+/_=-]++)*+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?$",  # paths, slugs
    # fields that are words, short numbers or placeholders, all of them
    r"^(?>(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}|(?i:(?:my|your|example|placeholder|changeme|x{4,})[a-z]{0,12}[0-9]{0,4}|(?:0123456789|abcdefgh)(?:0123456789|abcdef(?:gh(?:ijkl(?!mnop))?)?|ijklmnop(?:qrstuvwxyz)?)*+))(?:[+/_=-]+|$))++$",
)

SPAN = "struct<s:int,k:int,e:int,v:string>"


def match_spans(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0) -> Column:
    """Start, kind, end and string of the non-overlapping matches, leftmost
    first, whose ``group`` has ``least`` characters.  The pieces between the
    matches (``split``) and the matches alternate, so running lengths give the
    positions."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m"), kept.alias("g")), lambda x: F.struct(
        F.length(x["p"]).alias("p"), x["m"].alias("m"), F.length(x["g"]).alias("g")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(rank).alias("k"), e.alias("e"), x["m"].alias("v")).cast(SPAN))
        return F.struct(e.alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _n_log_n(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def high_windows(string: Column, window: int, least: float) -> Column:
    """``struct(lo, hi)``: from the first to the last window of the string with
    at least ``least`` bits of entropy; ``lo`` is -1 if there is none."""
    codes = F.transform(F.slice(F.split(string, ""), F.lit(1), F.length(string)),
                        lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            n_in, n_out = F.get(acc["n"], enters), F.get(acc["n"], leaves)
            gain = _n_log_n(n_in + 1) - _n_log_n(n_in)
            loss = F.when(leaves >= 0, _n_log_n(n_out) - _n_log_n(n_out - 1)).otherwise(F.lit(0.0))
            total = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + gain - loss)
            high = (i >= window - 1) & (F.log2(F.lit(float(window))) - total / F.lit(float(window)) >= least - 1e-9)
            return F.struct(
                F.transform(acc["n"], lambda v, k: v + (k == enters).cast("int") - (k == leaves).cast("int")).alias("n"),
                total.alias("sum"), F.when(high & (acc["lo"] < 0), i - window + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(high, i + 1).otherwise(acc["hi"]).alias("hi"))

        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return F.transform(F.array(codes), scan)[0]       # the codes are made once


def uncovered(c: Column, base: Column) -> Column:
    """What the base spans (by start) leave of a candidate, in pieces that are long enough."""
    def piece(s: Column, e: Column) -> Column:
        return F.when(e - s >= SHORTEST, F.array(F.struct(s.alias("s"), c["k"].alias("k"), e.alias("e"), c["v"].substr(s - c["s"] + 1, e - s).alias("v")).cast(
            SPAN))).otherwise(F.array().cast(f"array<{SPAN}>"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["s"])).alias("out"))

    inside = F.filter(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    zero = F.struct(c["s"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    cut = F.aggregate(inside, zero, step, lambda acc: F.concat(acc["out"], piece(acc["at"], c["e"])))
    return F.when(F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), cut).otherwise(F.array(c))


def entropy_spans(candidates: Column, base: Column, rank: int) -> Column:
    """High-entropy spans of what no allow rule or base span covers of the candidates."""
    def one(c: Column) -> Column:
        got = F.lit(None).cast("struct<lo:int,hi:int>")
        for pattern, window, least in reversed(CLASSES.values()):
            got = F.when(c["v"].rlike(pattern), F.when(F.length(c["v"]) >= window, high_windows(c["v"], window, least))).otherwise(got)
        return F.transform(F.array(got), lambda w: F.struct(
            (c["s"] + w["lo"]).alias("s"), F.lit(rank).alias("k"), (c["s"] + w["hi"]).alias("e"),
            F.when(w["lo"] >= 0, c["v"]).alias("v")).cast(SPAN))[0]

    pieces = F.flatten(F.transform(candidates, lambda c: uncovered(c, base)))
    allowed = F.filter(pieces, lambda c: ~_any([c["v"].rlike(p) for p in ALLOW]))
    return F.filter(F.transform(allowed, one), lambda x: x["v"].isNotNull())


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` per document."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a run of 24 characters found whole is what a shorter pattern finds and the length keeps; so for 20 from AKIA on
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), match_spans(body, ASSIGN, 0, LEAST["assign"], 2).alias("assign"),
        match_spans(body, ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4)), 1).alias("access"),
        match_spans(body, HEX.replace("+", "{%d,}" % LEAST["hex"]), 2).alias("hex"),
        match_spans(body, CANDIDATE, 3).alias("candidates"))
    based = found.select("doc_id", "candidates", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                         F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    added = based.select("*", entropy_spans(F.col("candidates"), F.col("base"), 3).alias("entropy"),
                         F.sha2(span_list(F.col("base")), 256).alias("base_sha256"))
    return added.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                        span_list(F.array_sort(F.concat("base", "entropy"))).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span of ``scan_secrets`` replaced by ``mark``
    (overlapping spans by one).  Ids must be unique."""
    spans = scan_secrets(docs).where(F.col("spans") != "").select("doc_id", F.transform(
        F.split("spans", ","), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"))).alias("cuts"))
    rows = docs.join(spans.withColumnRenamed("doc_id", "cut_id"), F.col("doc_id").eqNullSafe(F.col("cut_id")), "left").drop("cut_id")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        gap = F.expr("text").substr(acc["at"] + 1, F.greatest(c["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"),
                        F.when(c["s"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("cuts", zero, step, lambda acc: F.concat(acc["out"], F.expr("text").substr(acc["at"] + 1, F.length("text"))))
    return rows.withColumn("text", F.when(F.col("cuts").isNotNull(), done).otherwise(F.col("text"))).drop("cuts")
