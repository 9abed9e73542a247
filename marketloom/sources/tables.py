"""Baskets from long tables, and stored rule counts per itemset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = "itemset array<int>, support bigint, n30 bigint, n50 bigint, n70 bigint"
MANIFEST_SCHEMA = "lmax int, ni int, save string, n_sets bigint"


def baskets_from_table(df: DataFrame, tid_col: str, item_col: str) -> DataFrame:
    """Baskets (tid, items) of a table with a row for each item of a transaction."""
    return df.groupBy(F.col(tid_col).alias("tid")).agg(F.array_sort(F.collect_set(F.col(item_col).cast("int"))).alias("items"))


def save_itemset_stats(stats: DataFrame, path: str, lmax: int, ni: int) -> None:
    """Store rule counts under their parameters, in place of what was stored under them before. The result may be empty.

    ``path`` holds the counts, in a folder for each save, and a small table that names the save which holds for each (lmax, ni) and its number of sets.
    The latter changes last and at once, so a save that breaks off leaves what was there before.
    """
    spark, save = stats.sparkSession, uuid.uuid4().hex
    stats.withColumns({"lmax": F.lit(lmax), "ni": F.lit(ni), "save": F.lit(save)}).write.mode("append").partitionBy("lmax", "ni", "save").parquet(f"{path}/stats")
    entry = spark.createDataFrame([(lmax, ni, save, _of_save(spark, path, save).count())], MANIFEST_SCHEMA)
    context = spark.sparkContext
    manifest = context._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    known = manifest.getFileSystem(context._jsc.hadoopConfiguration()).exists(manifest)
    before = [r["save"] for r in _entries(spark, path, lmax, ni).collect()] if known else []
    entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lmax", "ni").parquet(f"{path}/manifest")
    for old in before:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/lmax={lmax}/ni={ni}/save={old}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _of_save(spark: SparkSession, path: str, save: str) -> DataFrame:
    return spark.read.schema(f"{STATS_SCHEMA}, lmax int, ni int, save string").parquet(f"{path}/stats").where(F.col("save") == save).drop("lmax", "ni", "save")


def saved_itemset_stats(spark: SparkSession, path: str) -> DataFrame:
    """(lmax, ni, save, n_sets) of what is stored there."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")


def _entries(spark: SparkSession, path: str, lmax: int, ni: int) -> DataFrame:
    return saved_itemset_stats(spark, path).where((F.col("lmax") == lmax) & (F.col("ni") == ni))


def load_itemset_stats(spark: SparkSession, path: str | None, lmax: int, ni: int) -> DataFrame:
    """What was stored for these parameters; no path starts empty, other parameters raise."""
    if path is None or path == "-":
        return spark.createDataFrame([], STATS_SCHEMA)
    known = _entries(spark, path, lmax, ni).first()
    if known is None:
        raise ValueError(f"nothing stored for lmax={lmax}, ni={ni}")
    return _of_save(spark, path, known["save"])
