"""SparkSession helpers.

On a cluster the session comes from the platform; ``get_session`` only fills in
settings that the running session or the launcher has left unset.
``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session.  Where it is
unset, a local session (tests, bench) gets a fresh folder and any other master
raises: executors on other machines could not read a machine-local folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": os.environ.get("TABFORGE_DRIVER_MEMORY", "16g"),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabforge") -> SparkSession:
    """The active session, or a new one; settings already made are kept."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    given = SparkConf()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions and not given.contains("spark.sql.shuffle.partitions"):
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """True when driver and executors are one process (``local``, ``local[n]``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not is_local(spark):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabforge-ckpt-"))
    return folder or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabforge-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: every
    later pass sees the same rows, whatever executors are lost meanwhile."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append((out, path))
    return out


_scope: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete_work(spark: SparkSession, path: str) -> None:
    """Delete what was put at a ``work_path``."""
    _delete(spark, path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` in the scope of ``scratch_tables`` once
    all that was made of it is written too; outside of one it stays."""
    scope = _scope.get() or []
    for i, (table, path) in enumerate(scope):
        if table is df:
            _delete(df.sparkSession, path)
            del scope[i]
            return


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the
    function this yields: write what is wanted of them before.  The kept ones
    belong to the scope outside, if there is one."""
    outside = _scope.get()
    token = _scope.set([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
        for table, path in _scope.get():
            if not any(table is k for k in kept):
                _delete(spark, path)
            elif outside is not None:
                outside.append((table, path))
    finally:
        _scope.reset(token)
