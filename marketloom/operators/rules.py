"""Rules of itemsets, their counts, histograms and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.parameters import rule_space
from marketloom.functions.scalars import div_or_zero, subsets
from marketloom.sources.text import BOUNDS

THRESHOLDS = {"30": 0.3, "50": 0.5, "70": 0.7}


def rules_from_itemsets(itemsets: DataFrame, supports: DataFrame, *keys: str, strict: bool = False) -> DataFrame:
    """Every rule antecedent -> rest of every set of two or more items: itemset, antecedent, consequent, sup_ab, sup_a, conf.

    ``supports`` (itemset, support) gives both supports. Where that of an antecedent is missing the rule has null values, or raises when ``strict``.
    """
    sets = itemsets.where(F.size("itemset") >= 2).select(*keys, "itemset").join(supports.select("itemset", F.col("support").alias("sup_ab")), "itemset", "left")
    each = sets.select(*keys, "itemset", "sup_ab", F.explode(subsets("itemset")).alias("antecedent"))
    known = supports.select(F.col("itemset").alias("antecedent"), F.col("support").alias("sup_a"))
    joined = each.join(known, "antecedent", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no support of "), F.array_join(F.col("antecedent").cast("array<string>"), " "))).cast("bigint")
        joined = joined.withColumn("sup_a", F.when(F.col("sup_a").isNull(), missing).otherwise(F.col("sup_a")))
    return joined.select(*keys, "itemset", "antecedent", F.array_except("itemset", "antecedent").alias("consequent"), "sup_ab", "sup_a", div_or_zero("sup_ab", "sup_a").alias("conf"))


def rule_points(supports: DataFrame, rmax: int | None = None, proper: bool = True) -> DataFrame:
    """(itemset, antecedent, sup_a, sup_ab, len_a, len_ab) of every rule; not ``proper`` also has antecedent = itemset. Raises where a
    subset has no support."""
    sets = supports if rmax is None else supports.where(F.size("itemset") <= rmax)
    each = sets.select("itemset", F.col("support").alias("sup_ab"), F.explode(subsets("itemset", proper=proper)).alias("antecedent"))
    joined = each.join(supports.select(F.col("itemset").alias("antecedent"), F.col("support").alias("sup_a")), "antecedent", "left")
    missing = F.raise_error(F.concat(F.lit("no support of "), F.array_join(F.col("antecedent").cast("array<string>"), " "))).cast("bigint")
    return joined.select("itemset", "antecedent", F.when(F.col("sup_a").isNull(), missing).otherwise(F.col("sup_a")).alias("sup_a"), "sup_ab", F.size("antecedent").alias("len_a"), F.size("itemset").alias("len_ab"))


def confident_rules(rules: DataFrame, threshold: float) -> DataFrame:
    return rules.where(F.col("conf") > threshold)


def nonzero_conf(rules: DataFrame) -> DataFrame:
    """Rules that a histogram counts: with a confidence that is a number and not 0."""
    return rules.where(F.col("conf").isNotNull() & ~F.isnan("conf") & (F.col("conf") != 0))


def rule_counts(rules: DataFrame, *keys: str) -> DataFrame:
    """Per itemset the rules with confidence over .3, .5 and .7: n30, n50, n70."""
    return rules.groupBy(*keys, "itemset").agg(*(F.count_if(F.col("conf") > t).alias(f"n{n}") for n, t in THRESHOLDS.items()))


def conf_range(rules: DataFrame) -> DataFrame:
    """Least and greatest confidence, zero included; 1 and 0 where there are no rules."""
    return rules.agg(F.coalesce(F.min("conf"), F.lit(1.0)).alias("min_conf"), F.coalesce(F.max("conf"), F.lit(0.0)).alias("max_conf"))


def conf_histogram(rules: DataFrame, *keys: str) -> DataFrame:
    """Ten bins (bound, bound + .1] with n, frac, and both summed from .9 downwards: bin, bound, n, frac, cum_n, cum_frac.

    With keys, one histogram for each combination that has a rule.
    """
    conf, number = F.col("conf"), None
    for k, b in enumerate(BOUNDS):
        number = F.when(conf > b, k) if number is None else number.when(conf > b, k)
    counted = nonzero_conf(rules).groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(b).alias("bound")) for k, b in enumerate(BOUNDS))))
    spark = rules.sparkSession
    every = (rules.select(*keys).distinct() if keys else spark.range(1).select()).select(*keys, bins.alias("b")).select(*keys, "b.bin", "b.bound")
    full = every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return cumulative(full, *keys)


def cumulative(hist: DataFrame, *keys: str) -> DataFrame:
    """A histogram's share, running count and running share from .9 downwards."""
    down = Window.partitionBy(*keys).orderBy(F.desc("bound")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*keys))
    running = F.sum("n").over(down)
    return hist.select(*keys, "bin", "bound", "n", div_or_zero("n", total).alias("frac"), running.alias("cum_n"), div_or_zero(running, total).alias("cum_frac"))


def merge_real_private(real: DataFrame, private: DataFrame) -> DataFrame:
    """One row per itemset: real counts n30, n50, n70, whether it was seen privately, and its private counts p30, p50, p70."""
    seen = private.select("itemset", *(F.col(f"n{n}").alias(f"p{n}") for n in THRESHOLDS), F.lit(True).alias("dpseen"))
    both = real.select("itemset", *(f"n{n}" for n in THRESHOLDS)).join(seen, "itemset", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return both.select("itemset", *(zero(f"n{n}") for n in THRESHOLDS), F.coalesce("dpseen", F.lit(False)).alias("dpseen"), *(zero(f"p{n}") for n in THRESHOLDS))


def recall_report(merged: DataFrame) -> DataFrame:
    """Per threshold the totals of private and real rules and their ratio, which may exceed 1."""
    sums = merged.agg(*(F.coalesce(F.sum(f"{k}{n}"), F.lit(0)).alias(f"{k}{n}") for k in "np" for n in THRESHOLDS))
    rows = F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"p{n}").alias("private"), F.col(f"n{n}").alias("real")) for n, t in THRESHOLDS.items())))
    return sums.select(rows).withColumn("recall", div_or_zero("private", "real"))


def estimated_recall(hist: DataFrame, private: DataFrame, n_items: int, lmax: int) -> DataFrame:
    """Recall against an estimate of the real rules: the size of the rule space times the share of rules over the threshold, truncated.

    ``hist`` is of the private rules; ``private`` has their counts per itemset.
    """
    space = rule_space(n_items, lmax)
    sums = private.agg(*(F.coalesce(F.sum(f"n{n}"), F.lit(0)).alias(f"n{n}") for n in THRESHOLDS))
    shares = hist.where(F.col("bound").isin(list(THRESHOLDS.values()))).select(F.col("bound").alias("threshold"), (F.lit(space) * F.col("cum_frac")).cast("bigint").alias("estimated"))
    rows = sums.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{n}").alias("private")) for n, t in THRESHOLDS.items()))))
    return shares.join(rows, "threshold").select("threshold", "private", "estimated", div_or_zero("private", "estimated").alias("recall"))


def rule_count_of_itemsets(itemsets: DataFrame) -> DataFrame:
    """Rules that the listed sets have together."""
    return itemsets.agg(F.coalesce(F.sum((F.pow(F.lit(2.0), F.size("itemset")) - 2).cast("bigint")), F.lit(0)).alias("n_rules"))


def lattice_check(supports: DataFrame) -> DataFrame:
    """Whether the listed sets are all non-empty subsets of their items: the numbers of sets and rules that this needs, and that there are."""
    n = F.count_if(F.size("itemset") == 1)
    found = supports.agg(n.alias("n_items"), F.count("*").alias("n_itemsets"), F.coalesce(F.sum((F.pow(F.lit(2.0), F.size("itemset")) - 2).cast("bigint")), F.lit(0)).alias("n_rules"))
    sets, rules = F.pow(F.lit(2.0), "n_items") - 1, F.pow(F.lit(3.0), "n_items") - F.pow(F.lit(2.0), F.col("n_items") + 1) + 1
    return found.withColumn("complete", (F.col("n_itemsets") == sets) & (F.col("n_rules") == rules))


def distinct_rule_digits(lines: DataFrame) -> DataFrame:
    """Distinct rule lines by the first decimal of their confidence (digit, n), all ten; a confidence of 1 is in none."""
    digit = F.regexp_extract("value", r"c=\s*0\.(\d)[^ ]*$", 1)
    counted = lines.select("value").distinct().where(digit != "").groupBy(digit.cast("int").alias("digit")).agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(10).select(F.col("id").cast("int").alias("digit"))
    return every.join(counted, "digit", "left").select("digit", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
