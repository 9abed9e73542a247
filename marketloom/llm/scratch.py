"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and driver and tasks share one
machine, as in tests, a temporary folder is used. A table that has been written cuts the lineage: a lost executor costs
the tasks that were running on it, not the work behind the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-marketloom-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_folder(spark)}/marketloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows with the smallest hash of the keys, or all if there are no more.

    A cut of the hash that at least ``rows`` rows pass comes first: each task would otherwise send as many rows as are wanted from all of
    them to the one task that picks. The cut is the smallest power of two with enough rows below it, so about twice as many pass, and
    more only where many rows have equal keys.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    below = 0
    for bits, n in sorted(map(tuple, df.groupBy(F.length(F.bin(h)).alias("bits")).count().collect())):  # 40 rows at most
        below += n
        if below >= rows:
            return df.where(h < 1 << bits).orderBy(h, *keys).limit(rows)
    return df
