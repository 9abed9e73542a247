"""Written intermediate tables, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Paths that the innermost ``temporary`` block has written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has. Only where no folder is named and all runs on one machine, it is a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-marketloom-"))
        folder = _LOCAL[0]
    return f"{folder.rstrip('/')}/baskets/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once, which also cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing will read any more."""
    context = spark.sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end, so its result must be stored by ``kept`` before."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        discard(spark, *paths)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Store the result of a ``temporary`` block, which outlives it."""
    token = _written.set(None)
    try:
        return stored(df, name)
    finally:
        _written.reset(token)
