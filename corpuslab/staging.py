"""Intermediate tables in the folder that all executors share.

Reading a staged table back does three things: the lineage is cut in a way that survives the loss
of an executor, columns are pruned on re-use, and its size on disk is known, so Catalyst broadcasts
it only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Paths that the innermost open scope of this thread has to delete; None outside of scopes.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned_paths", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslab-"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; an open scope deletes it at its end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


@contextmanager
def owned_staging(spark: SparkSession) -> Iterator[None]:
    """A scope that deletes every path made in it, at its end or when it fails.

    What is needed after it has to be written elsewhere or passed through ``detached`` before. An
    inner scope deletes its own paths only.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = hadoop(path)
            target.getFileSystem(conf).delete(target, True)


def detached(df: DataFrame) -> DataFrame:
    """A report of few rows as a table of literals that depends on no file."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def owns_staging(job: Callable) -> Callable:
    """A job, with the session as its first argument, whose staged tables end with it."""

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with owned_staging(spark):
            return job(spark, *args, **kwargs)

    return run


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
