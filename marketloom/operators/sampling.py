"""Draws: noisy counts, weighted samples without replacement, and scores turned into probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import hash_uniform, items_text, laplace_mechanism, quality_d, quality_delta, rule_quality, sampling_key, sampling_key_log
from marketloom.operators.items import item_cell, placed

#: Spark cuts groups to a constant number of rows up to this one before it moves them; beyond, groups are cut in so many parts.
LIMITED, PARTS = 1000, 64


def noisy_items(counts: DataFrame, eps: float, seed: int) -> DataFrame:
    """(item, real_count, noisy_count, pos): counts released with ``eps`` and ranked by what was released. Give zero-filled counts."""
    u = hash_uniform(seed, F.lit("count"), F.col("item"))
    noisy = counts.select("item", F.col("cnt").alias("real_count"), laplace_mechanism("cnt", u, eps).alias("noisy_count"))
    # many counts are cut to 0 and are told apart by item only
    none = F.col("noisy_count") == 0
    band = F.when(none, F.lit(-1.0)).otherwise(F.floor("noisy_count").cast("double"))
    return placed(noisy, "pos", band, F.when(none, item_cell()).otherwise(F.lit(0)), [F.desc("noisy_count"), F.col("item")])


def above_noise_floor(noisy: DataFrame, eps: float, scale: float = 2.3) -> DataFrame:
    """Items whose noisy count is no less than nine tenths of all noise."""
    return noisy.where(F.col("noisy_count") >= scale / eps)


def top_noisy_items(noisy: DataFrame, ni: int) -> DataFrame:
    return noisy.where(F.col("pos") <= ni)


def smallest(df: DataFrame, group: list[str], k: int | Column, order: list[str | Column], most: int | None = None, name: str = "draw") -> DataFrame:
    """The first ``k`` rows of each group in that order, numbered from 1 in column ``name``. ``most``: no ``k`` is greater.

    Each task sends no more than ``most`` rows of a group to where the group meets, so one with most of all rows is no hot group. Where
    ``most`` is unknown or too great for that, parts of the groups are cut to ``k`` rows first.
    """
    most = k if isinstance(k, int) else most
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    limit = F.lit(k) if isinstance(k, int) else k
    if most is None or most > LIMITED:
        df = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))).withColumn(name, number(*group, "_part")).where(F.col(name) <= limit).drop(name, "_part")
        return df.withColumn(name, number(*group)).where(F.col(name) <= limit)
    # a constant bound lets Spark cut each task's rows of a group before they are moved
    cut = df.withColumn(name, number(*group)).where(F.col(name) <= F.lit(most))
    return cut if isinstance(k, int) else cut.where(F.col(name) <= limit)


def weighted_sample(df: DataFrame, group: list[str], k: int | Column, weight: str, u: Column, ties: list[str], log_weight: bool = False, most: int | None = None) -> DataFrame:
    """Up to ``k`` rows of each group, drawn by weight without replacement: those with the smallest key ``v``, which stays as a column.

    ``most``: no ``k`` is greater.
    """
    key = sampling_key_log(u, weight) if log_weight else sampling_key(u, weight)
    return smallest(df.withColumn("v", key), group, k, ["v", *ties], most)


def class_draws(prefixes: DataFrame, level: int, slots: int) -> DataFrame:
    """(the columns of ``prefixes``, slot, item, v): the candidates of one score 0 in the order in which they would be drawn, up to ``slots`` of each.

    ``prefixes`` (seed, prefix, zeros): the items of ``zeros`` have keys v = ln(-ln u) each, of which only the smallest can win. These are
    order statistics: the gaps between sorted exponentials are exponentials over the number that is left, and which item a place falls to
    is uniform among them. So a few numbers are drawn for each prefix instead of one for each item.
    """
    left = lambda i: F.size("zeros") - i + 1
    own = lambda name, i: hash_uniform(F.col("seed"), F.lit(level), items_text("prefix"), F.lit(name), i)
    places = F.sequence(F.lit(1), F.least(F.lit(slots), F.size("zeros")))
    nothing = F.struct(F.lit(0.0).alias("e"), F.col("zeros").alias("rest"), F.array().cast("array<struct<slot: int, item: int, v: double>>").alias("found"))

    def draw(at: Column, i: Column) -> Column:
        e = at["e"] - F.log(own("zero", i)) / left(i)
        place = F.floor(own("which", i) * left(i)).cast("int")
        rest = F.concat(F.slice(at["rest"], 1, place), F.slice(at["rest"], place + 2, F.size("zeros")))
        found = F.struct(i.cast("int").alias("slot"), F.get(at["rest"], place).alias("item"), F.log(e).alias("v"))
        return F.struct(e.alias("e"), rest.alias("rest"), F.concat(at["found"], F.array(found)).alias("found"))

    drawn = F.when(F.size("zeros") > 0, F.aggregate(places, nothing, draw)["found"])
    return prefixes.select(*prefixes.columns, F.inline(drawn))


def extension_quality(candidates: DataFrame, method: str = "sigma", c0: float = 0.5, asymmetric: bool = False) -> DataFrame:
    """Column ``q`` of candidates (prefix, item, support, sup_prefix, cnt of the item)."""
    if method == "sigma":
        q = F.col("support").cast("double")
    elif method == "delta":
        q = quality_delta("support", "sup_prefix").cast("double")
    elif method == "d":
        q = quality_d("support", "cnt", c0, asymmetric)
    else:
        raise ValueError(f"unknown quality {method}")
    return candidates.withColumn("q", q)


def reduced_delta(supports: DataFrame, reduce: str = "max") -> DataFrame:
    """(itemset, q): support less the greatest (``max`` score: least) support of a proper subset of at least one item."""
    from marketloom.operators.rules import rule_points

    best = F.min("sup_a") if reduce == "max" else F.max("sup_a")
    return rule_points(supports).groupBy("itemset").agg((F.first("sup_ab") - best).alias("q"))


def em_probabilities(points: DataFrame, method: str, m: float, theta: float, eps: float = 0.1, a: float = 1e6, b: float = 1e3) -> DataFrame:
    """(sup_a, sup_ab, q, p) of the distinct points: exp(eps q / 2) over its sum, computed from the largest score downwards."""
    scored = points.select("sup_a", "sup_ab").distinct().withColumn("q", rule_quality("sup_a", "sup_ab", method, m, theta, a, b))
    top = scored.agg(F.max("q").alias("top"))
    shifted = scored.join(F.broadcast(top)).withColumn("e", F.exp(F.lit(eps) / 2 * (F.col("q") - F.col("top"))))  # one row
    total = shifted.agg(F.sum("e").alias("z"))
    return shifted.join(F.broadcast(total)).select("sup_a", "sup_ab", "q", (F.col("e") / F.col("z")).alias("p"))


def rules_by_quality(points: DataFrame, by: str = "q") -> DataFrame:
    return points.orderBy(F.desc(by), "sup_a", "sup_ab")
