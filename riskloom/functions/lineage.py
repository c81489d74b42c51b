"""Cutting long lineages so that lost executors can be replaced, and shared storage for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="riskloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own, made once; on a cluster
    a folder of the driver's machine would lose data, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder()
    return named.rstrip("/")


_made: list[str] = []
_scope = threading.local()


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the shared folder; :func:`release` or the end of its scope deletes it."""
    made = getattr(_scope, "made", _made)
    made.append(f"{shared_folder(spark)}/riskloom-{uuid.uuid4().hex}")
    return made[-1]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread makes inside are deleted at the end: for batches of a stream that runs for long."""
    before, _scope.made = getattr(_scope, "made", _made), []
    try:
        yield
    finally:
        made, _scope.made = _scope.made, before
        _delete(spark, made)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far; frames that still read them must not be used any more."""
    return _delete(spark, _made)


def _delete(spark: SparkSession, made: list[str]) -> int:
    deleted, hadoop = 0, spark._jvm.org.apache.hadoop.fs
    while made:
        path = hadoop.Path(made.pop())
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def checkpointed(df: DataFrame) -> DataFrame:
    """The data written to the session's checkpoint folder and read back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a Parquet table in the shared folder and read back with their schema.

    Unlike a checkpoint it keeps columns apart, so later steps read only those they need.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
