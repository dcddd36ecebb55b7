"""Corpus pipeline: the stages of a training-data job in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; the last returns the pieces of the
packed sequences.  ``docs`` needs ``doc_id``, ``text`` and ``lang``; other
columns pass through, whatever their names are.

Defined cases, for each stage: an empty table gives an empty one with the same
columns; a NULL ``doc_id`` is a value like any other; repeated rows are equal
documents, of which ``near_duplicates`` keeps one; a text that is NULL, empty or
has no letter goes in ``language``; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.decontaminate import drop_contaminated
from tabforge.llm.langid import UNDETERMINED, identify, train
from tabforge.llm.linededup import dedup_lines
from tabforge.llm.packing import pack_documents
from tabforge.llm.sigtree import keep_one
from tabforge.session import scratch_tables, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` and the other columns as one, ``others``, so that
    no operator's own column can have the name of one of them."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("doc_id", "text", "lang")]
    return docs.select("doc_id", "text", "lang", F.struct(*(others or [F.lit(0)])).alias("others"))


def _restored(found: DataFrame, docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` from what came of ``_aside``, some of them changed."""
    def column(c: str) -> Column:
        return F.col(c) if c in ("doc_id", "text", "lang") else F.col(f"others.`{c.replace('`', '``')}`")

    return found.select(*[changed.get(c, column(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification trained on the rows that have a language.
    Documents whose text is NULL, empty or without a letter go; ``lang`` becomes
    the prediction, and stays as it is where no row has one to learn from."""
    texts = docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(_aside(texts), train(docs.select("doc_id", "text", "lang")))
    return _restored(found, docs, {"lang": F.coalesce(F.nullif("lang_pred", F.lit(UNDETERMINED)), "lang")})


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out.  Documents
    of which nothing is left go; ``n_chars`` follows the new text."""
    cut = dedup_lines(_aside(docs)).where("n_removed < n_lines OR n_lines = 0")
    changed = {}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("others.n_chars"))
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return _restored(cut, docs, changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of 2048 tokens."""
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", packing),
]

#: No SQL engine has the models and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_tables(spark) as keep:     # what a stage wrote on its way goes once its result is there
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
