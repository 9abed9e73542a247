"""Tables of experiments: averages, precision and recall series, pivots of histograms, parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import div_or_zero, name_part


def param_grid(spark: SparkSession, limit: int | None = None, **values: list) -> DataFrame:
    """All combinations of the values with a run_id; with ``limit``, those of which shelves times bins stays within it."""
    names = list(values)
    rows = [dict(zip(names, c, strict=True)) for c in product(*values.values())]
    if limit is not None:
        rows = [r for r in rows if r["shelves"] * r["bins"] <= limit]
    return spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], ["run_id", *names])


def average_runs(runs: DataFrame) -> DataFrame:
    """Per configuration the mean rules, rules50 and real rules (R, R50, RR), and precision and recall as ratios of means."""
    means = runs.groupBy("db", "eps", "c0", "rmax", F.col("nits").alias("ni"), "bf").agg(F.avg("rules").alias("R"), F.avg("rules50").alias("R50"), F.avg("realrls").alias("RR"))
    return means.withColumns({"precision": div_or_zero("R50", "R"), "recall": div_or_zero("R50", "RR")})


def sorted_report(averaged: DataFrame) -> DataFrame:
    return averaged.orderBy("db", "eps", "c0", "rmax", "ni", "bf")


def series(averaged: DataFrame, db: str, eps: float, c0: float, rmax: int, key_col: str, key: int, x: str, y: str) -> DataFrame:
    """Points (x, y) of the configurations whose dataset name contains ``db``."""
    own = F.col("db").contains(db) & (F.col("eps") == eps) & (F.col("c0") == c0) & (F.col("rmax") == rmax) & (F.col(key_col) == key)
    return averaged.where(own).select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy("x", "y")


def good_vs_all(averaged: DataFrame, db: str, rmax: int, eps: float = 0.5, c0: float = 0.5) -> DataFrame:
    return averaged.where(F.col("db").contains(db) & (F.col("rmax") == rmax) & (F.col("eps") == eps) & (F.col("c0") == c0)).select("R", "R50").orderBy("R", "R50")


def precision_vs_k(alpha_runs: DataFrame, db: str, rmax: int, alpha: int = 1) -> DataFrame:
    return alpha_runs.where(F.col("db").contains(db) & (F.col("rmax") == rmax) & (F.col("alpha") == alpha)).select("k", "precision").orderBy("k", "precision")


def precision_vs_eps(table: DataFrame, dataset: str, length: int, k: int) -> DataFrame:
    own = (F.col("dataset") == dataset) & (F.col("length") == length) & (F.col("k") == k)
    return table.where(own).select("eps", "p90", "p70", "p50").orderBy("eps")


def precision_by_k(table: DataFrame, dataset: str, length: int, eps: float = 0.5) -> DataFrame:
    own = (F.col("dataset") == dataset) & (F.col("length") == length) & (F.col("eps") == eps)
    return table.where(own).select("k", "p90", "p70", "p50").orderBy("k")


def complete_series(df: DataFrame, keys: list[str], n_points: int) -> DataFrame:
    """Only the series with exactly that many points."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") == n_points).drop("_n")


def with_baseline(method: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Rows of both in one table, told apart by ``method``; only of the series, named by ``keys``, that both have. Null keys match nothing."""
    both = method.select(*keys).distinct().join(baseline.select(*keys).distinct(), list(keys)) if keys else None
    own = lambda df, name: (df if both is None else df.join(both, list(keys), "left_semi")).withColumn("method", F.lit(name))
    return own(method, "method").unionByName(own(baseline, "baseline"), allowMissingColumns=True)


def average_histograms(hists: DataFrame, exp_cols: list[str], run_col: str, expected: str) -> DataFrame:
    """Per experiment and bound: mean cumulative count, its share of the mean total and of the ``expected`` number.

    Runs without all ten bounds are left out.
    """
    whole = hists.withColumn("_n", F.count("*").over(Window.partitionBy(*exp_cols, run_col))).where("_n = 10")
    means = whole.groupBy(*exp_cols, "bound").agg(F.avg("cum_n").alias("mean_cum"), F.first(expected).alias("expected"), F.count("*").alias("runs"))
    total = F.max("mean_cum").over(Window.partitionBy(*exp_cols))
    return means.select(*exp_cols, "bound", "runs", total.alias("mean_total"), "mean_cum", F.try_divide("mean_cum", total).alias("of_total"), F.try_divide("mean_cum", "expected").alias("of_expected"))


def layer_bin_matrix(hists: DataFrame, count: int, file_col: str = "file") -> DataFrame:
    """Mean cumulative counts per bound and number of shelves, a column for each number of bins from 1 to 10; shelves and bins come from
    the file name."""
    named = hists.select("bound", "cum_n", name_part(file_col, 3).cast("int").alias("shelves"), name_part(file_col, 1).cast("int").alias("bins"))
    return named.groupBy("bound", "shelves").pivot("bins", list(range(1, 11))).agg(F.sum("cum_n") / count).na.fill(0.0)


def matrix_to_series(matrix: DataFrame, bound: float) -> DataFrame:
    """One confidence block as (shelves, bins, value)."""
    return matrix.where(F.col("bound") == bound).unpivot("shelves", [str(i) for i in range(1, 11)], "bins", "value").select("shelves", F.col("bins").cast("int").alias("bins"), "value")
