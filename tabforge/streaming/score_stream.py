"""Streaming scoring (K5).

Scoring is a stateless projection, so the batch scorer applies unchanged to
a Structured Streaming DataFrame.  Output goes to a Parquet file sink in the
shared checkpoint folder (never to the driver), with its checkpoint beside
it, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabforge.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the Parquet files at ``path`` (a folder, or one file via a glob filter)."""
    schema = spark.read.parquet(path).schema
    folder, name = (os.path.dirname(path), os.path.basename(path)) if path.endswith(".parquet") else (path, None)
    r = spark.readStream.schema(schema)
    if name:
        r = r.option("pathGlobFilter", name)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def score_stream(stream: DataFrame, projection: Callable[[DataFrame], DataFrame],
                 scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return scorer(projection(stream))


def score_stream_once(spark: SparkSession, path: str, projection, scorer, out_dir: str | None = None) -> DataFrame:
    """Run the scoring stream over everything available now, then read the sink."""
    base = out_dir or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    scored = score_stream(read_stream(spark, path), projection, scorer)
    q = (scored.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
