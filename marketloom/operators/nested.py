"""All numbers of items of a sweep from one enumeration.

A set belongs to every list of the ``ni`` most frequent items from the rank of its least frequent item on, and to every ``lmax`` from its
size on. So what a set counts is added up once, by size and greatest rank, and the totals of every (lmax, ni) are running sums over these cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import div_or_zero
from marketloom.operators.rules import THRESHOLDS

TOTALS = ("n_sets", "n_rules", *(f"n{n}" for n in THRESHOLDS))


def greatest_ranks(itemsets: DataFrame, ranks: DataFrame, *carried: str) -> DataFrame:
    """(itemset, carried columns, greatest): the greatest rank of any item of each set. ``ranks`` must rank every item of the sets."""
    each = itemsets.select("itemset", *carried, F.explode("itemset").alias("item")).join(F.broadcast(ranks.select("item", "rank")), "item")
    return each.groupBy("itemset", *carried).agg(F.max("rank").alias("greatest"))


def cells(stats: DataFrame, ranks: DataFrame) -> DataFrame:
    """(size, greatest, n_sets, n_rules, n30, n50, n70) of the counts per itemset: as many rows as there are sizes and ranks."""
    counts = [f"n{n}" for n in THRESHOLDS]
    sets = greatest_ranks(stats.where(F.size("itemset") > 1), ranks, *counts)
    rules = F.sum((F.pow(F.lit(2.0), F.size("itemset")) - 2).cast("bigint"))
    return sets.groupBy(F.size("itemset").alias("size"), "greatest").agg(F.count("*").alias("n_sets"), rules.alias("n_rules"), *(F.sum(c).alias(c) for c in counts))


def nested_totals(cells: DataFrame, lmax: int, ni: int) -> DataFrame:
    """(lmax, ni, n_sets, n_rules, n30, n50, n70) for every lmax from 2 and ni from 1 up to those of the enumeration that the cells are of."""
    spark = cells.sparkSession
    sizes = spark.range(2, lmax + 1).select(F.col("id").cast("int").alias("size"))
    # a few rows for each rank: both are parameters
    grid = sizes.select("size", F.explode(F.sequence(F.lit(1), F.lit(ni))).alias("greatest"))
    full = grid.join(cells, ["size", "greatest"], "left").na.fill(0, list(TOTALS))
    by_rank = Window.partitionBy("size").orderBy("greatest").rowsBetween(Window.unboundedPreceding, 0)
    by_size = Window.partitionBy("greatest").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select("size", "greatest", *(F.sum(c).over(by_rank).alias(c) for c in TOTALS))
    return summed.select(F.col("size").alias("lmax"), F.col("greatest").alias("ni"), *(F.sum(c).over(by_size).alias(c) for c in TOTALS))


def nested_recall(private: DataFrame, runs: DataFrame, totals: DataFrame) -> DataFrame:
    """(run_id, threshold, private, real, recall) of all runs. ``private``: counts per run_id and itemset; ``runs``: run_id, lmax, ni."""
    sums = private.groupBy("run_id").agg(*(F.sum(f"n{n}").alias(f"p{n}") for n in THRESHOLDS))
    real = runs.select("run_id", "lmax", "ni").join(totals.select("lmax", "ni", *(f"n{n}" for n in THRESHOLDS)), ["lmax", "ni"]).join(sums, "run_id", "left")
    each = F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.coalesce(f"p{n}", F.lit(0)).alias("private"), F.col(f"n{n}").alias("real")) for n, t in THRESHOLDS.items())))
    return real.select("run_id", each).withColumn("recall", div_or_zero("private", "real"))
