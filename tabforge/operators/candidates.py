"""Training candidates as an append-only table.

Each candidate is one row in a shared folder, so a run that lost its driver, or
another one, finds them.  Which candidate holds the seat is a query over the
table: the first in order takes it; later baselines never displace it; the last
tuned candidate that is no worse than all before it does.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.constants import MAX_CANDIDATES
from tabforge.errors import DataError, ParamError

CANDIDATE_DDL = ("seq int, candidate_id string, algorithm string, method string, params string, "
                 "train_f1 double, validation_f1 double, best_cv_score double, model_path string")
BASELINE = "baseline"
POLICIES = ("reference", "max_val_f1")


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates so far; an absent folder holds none."""
    try:
        return spark.read.schema(CANDIDATE_DDL).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CANDIDATE_DDL)


def next_candidate(spark: SparkSession, folder: str, cap: int = MAX_CANDIDATES) -> tuple[int, str]:
    """Number and id of the next candidate; raises when there are ``cap`` (ask
    before fitting)."""
    n = read_candidates(spark, folder).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first().n
    if n >= cap:
        raise ParamError(f"At most {cap} training candidates are kept.")
    return n + 1, f"candidate_{n + 1}"


def append_candidate(spark: SparkSession, folder: str, algorithm: str, method: str, params: dict, metrics: dict,
                     model_path: str | None = None, cap: int = MAX_CANDIDATES) -> str:
    """Add a candidate and return its id."""
    seq, name = next_candidate(spark, folder, cap)
    row = (seq, name, algorithm, method, json.dumps(params, sort_keys=True, default=str), metrics.get("train_f1_weighted"),
           metrics.get("validation_f1_weighted"), metrics.get("best_cv_score"), model_path)
    spark.createDataFrame([row], CANDIDATE_DDL).coalesce(1).write.mode("append").parquet(folder)
    return name


def seat(candidates: DataFrame, policy: str = "reference", explicit: str | None = None) -> DataFrame:
    """The row of the candidate that holds the seat.  ``max_val_f1`` takes the first
    of the highest validation F1, or else score of the search.  A metric that is
    absent counts as -1."""
    if policy not in POLICIES:
        raise ParamError(f"policy must be one of {POLICIES}, got {policy!r}.")
    if explicit is not None:
        return candidates.where(F.col("candidate_id") == explicit)
    f1 = F.coalesce("validation_f1", F.lit(-1.0))
    row = F.struct(*candidates.columns)
    if policy == "max_val_f1":
        best = F.max_by(row, F.struct(F.coalesce("validation_f1", "best_cv_score", F.lit(-1.0)), -F.col("seq")))
        return candidates.agg(best.alias("r")).where("r IS NOT NULL").select("r.*")
    # a few rows at most: the window is over the table of candidates
    marked = candidates.withColumn("first_f1", F.first(f1).over(Window.partitionBy(F.lit(1)).orderBy("seq"))).withColumn(
        "first_seq", F.min("seq").over(Window.partitionBy(F.lit(1))))
    holds = marked.where((F.col("seq") == F.col("first_seq")) | ((F.col("method") != BASELINE) & (f1 >= F.col("first_f1"))))
    # the first only stays where no tuned one reaches it
    order = F.struct((F.col("seq") != F.col("first_seq")).alias("tuned"), f1.alias("f1"), F.col("seq"))
    return holds.agg(F.max_by(row, order).alias("r")).where("r IS NOT NULL").select("r.*")


def promote_row(candidates: DataFrame, policy: str = "reference", explicit: str | None = None) -> dict:
    """The chosen candidate for promotion; raises when there is none."""
    row = seat(candidates, policy, explicit).first()
    if row is None:
        raise ParamError(f"Unknown candidate {explicit!r}.") if explicit else DataError("No training candidates.")
    return row.asDict()
