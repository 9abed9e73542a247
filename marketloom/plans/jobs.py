"""Jobs: exact and private rules, sweeps over parameters, rule quality, chains of best extensions, experiment reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.parameters import budget
from marketloom.functions.scalars import canonical, hash_uniform, items_text, laplace_mechanism, quality_d, subsets
from marketloom.operators import experiments, items, itemsets, nested, rules, sampling
from marketloom.plans.stored import kept, stored, temporary
from marketloom.sources import text


def _checked_lmax(lmax: int) -> None:
    if not 2 <= lmax <= 7:
        raise ValueError("lmax must be from 2 to 7")


def exact_rules_job(baskets: DataFrame, lmax: int, ni: int, strategy: str = "auto") -> dict[str, DataFrame]:
    """Every rule of every set of up to ``lmax`` of the ``ni`` most frequent items: supports, rules and stats (rule counts per itemset)."""
    _checked_lmax(lmax)
    counts = items.item_counts(baskets)
    top = items.item_list(items.top_items(counts, ni))
    weighted = stored(items.weighted_baskets(items.restrict_to_items(baskets, top)), "weighted")
    singles = items.item_counts_weighted(weighted)
    supports = stored(itemsets.enumerate_itemsets(weighted, top, lmax, strategy).unionByName(singles), "supports")
    found = rules.rules_from_itemsets(supports, supports)
    stats = rules.rule_counts(found).join(supports, "itemset").select("itemset", "support", "n30", "n50", "n70")
    return {"supports": supports, "rules": found, "stats": stats}


def nested_job(baskets: DataFrame, lmax: int, ni: int) -> DataFrame:
    """(lmax, ni, n_sets, n_rules, n30, n50, n70) of the exact rules for every lmax from 2 and every ni up to these, from one enumeration."""
    ranks = items.top_items(items.item_counts(baskets), ni)
    place = F.row_number().over(Window.orderBy(F.desc("cnt"), "item"))  # of ``ni`` rows
    found = exact_rules_job(baskets, lmax, ni)["stats"]
    return nested.nested_totals(nested.cells(found, stored(ranks.withColumn("rank", place), "ranks")), lmax, ni)


@dataclass(frozen=True)
class Run:
    """Parameters of a private run: total budget, share for the item counts, confidence threshold, largest set, items kept, draws per prefix."""

    run_id: int
    eps: float
    ratio: float
    c0: float
    lmax: int
    ni: int
    bf: int
    seed: int = 42

    def __post_init__(self) -> None:
        _checked_lmax(self.lmax)
        budget(self.eps, self.ratio, self.lmax, self.bf)  # raises where out of range
        if not 0 <= self.c0 < 1:
            raise ValueError("c0 must be at least 0 and below 1")


def candidate_quality(candidates: DataFrame, weighted: DataFrame, counts: DataFrame, width: int, quality: str = "sigma", d_where: Column | bool = False, reduce: str | None = None, asymmetric: bool = False) -> DataFrame:
    """Column ``q`` of candidates (run_id, path, prefix of ``width`` items in the order drawn, item, support, sup_prefix, cnt, cnts of the
    prefix, c0). ``d_where``: candidates that are scored by d whatever the quality.

    ``reduce`` (max or min): d over the counts of all items, not the last one's; delta also over the first 1 to ``width`` - 1 items of the
    set with each of its items in turn swapped to the end.
    """
    if reduce not in (None, "max", "min"):
        raise ValueError(f"unknown reduction {reduce}")
    if quality == "delta" and reduce and width > 1:
        begins = [F.slice("prefix", 1, j) for j in range(1, width)]
        begins += [F.concat(F.slice("prefix", 1, a), F.array("item"), F.slice("prefix", a + 2, j - a - 1)) for j in range(1, width) for a in range(j)]
        parts = candidates.select("run_id", "path", "item", F.explode(F.array(*map(canonical, begins))).alias("itemset"))
        sups = itemsets.itemset_support(weighted, parts.select("itemset"), counts).withColumnRenamed("support", "sup")
        least = (F.min if reduce == "max" else F.max)("sup")  # the greatest score has the least support
        best = parts.join(sups, "itemset").groupBy("run_id", "path", "item").agg(least.alias("sup"))
        either = F.least if reduce == "max" else F.greatest
        candidates = candidates.join(best, ["run_id", "path", "item"]).withColumn("sup_prefix", either("sup_prefix", "sup")).drop("sup")
    scored = sampling.extension_quality(candidates, quality)
    if reduce:
        d = F.transform(F.concat("cnts", F.array("cnt")), lambda x: quality_d("support", x, F.col("c0"), asymmetric))
        d = (F.array_max if reduce == "max" else F.array_min)(d)
    else:
        d = quality_d("support", "cnt", F.col("c0"), asymmetric)  # c0 is the run's own
    where = F.lit(True) if quality == "d" else d_where if isinstance(d_where, Column) else F.lit(d_where)
    return scored.withColumn("q", F.when(where, d).otherwise(F.col("q")))


def private_leaves(weighted: DataFrame, counts: DataFrame, runs: list[Run], quality: str = "sigma", first_item: str = "noisy", forced_last: bool = False, reduce: str | None = None, asymmetric: bool = False, zeros: str = "grid") -> DataFrame:
    """The sets that each run draws: (run_id, path, itemset). ``path`` are the draws that led there, by which branches are ordered.

    ``counts`` must be zero-filled. All runs and branches of a level are one query; supports are shared by all runs.

    ``zeros``: with ``grid`` every prefix meets every item. With ``class``, for scores sigma only, the candidates that no basket holds
    are drawn as one class, so that only those with a support are rows; the numbers drawn differ, their distribution doesn't.
    """
    if zeros not in ("grid", "class") or (zeros == "class" and (quality != "sigma" or forced_last or reduce)):
        raise ValueError("zeros is grid, or class where all candidates are scored by sigma")
    spark = weighted.sparkSession
    spent = [budget(r.eps, r.ratio, r.lmax, r.bf, first_item) for r in runs]
    shares = [[x["levels"].get(i, 0.0) / r.bf for i in range(r.lmax)] for r, x in zip(runs, spent, strict=True)]
    rows = [(*asdict(r).values(), x["items"], s) for r, x, s in zip(runs, spent, shares, strict=True)]
    table = spark.createDataFrame(rows, "run_id int, eps double, ratio double, c0 double, lmax int, ni int, bf int, seed int, item_eps double, shares array<double>")
    noise = hash_uniform(F.col("seed"), F.lit("count"), F.col("item"))
    # a row for each run and item: the number of runs is the caller's list
    noisy = counts.crossJoin(F.broadcast(table)).withColumn("noisy_count", laplace_mechanism("cnt", noise, F.col("item_eps")))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("noisy_count"), "item"))
    top = stored(noisy.withColumn("pos", place).where("pos <= ni"), "noisy-items")
    share = lambda level: F.get("shares", F.lit(level))
    most = max(r.bf for r in runs)

    first = F.col("noisy_count") if first_item == "noisy" else share(0) * F.col("cnt") / 2
    drawn = sampling.weighted_sample(top.withColumn("logw", first), ["run_id"], F.col("bf"), "logw", hash_uniform(F.col("seed"), F.lit(0), F.lit(""), F.col("item")), ["item"], log_weight=True, most=most)
    level = stored(drawn.select("run_id", F.array("draw").alias("path"), F.array("item").alias("prefix"), F.col("cnt").alias("sup_prefix"), F.array("cnt").alias("cnts")), "level-0")
    leaves = None
    for i in range(1, max(r.lmax for r in runs)):
        open_ = level.join(F.broadcast(table.where(F.col("lmax") > i).select("run_id")), "run_id", "left_semi")
        known = itemsets.extension_supports(weighted, open_, counts).withColumnRenamed("prefix", "set")
        if zeros == "grid":
            grid = itemsets.exclude_prefix_items(open_.join(top, "run_id"))
            candidates = grid.withColumn("set", canonical("prefix")).join(known, ["set", "item"], "left").withColumn("support", F.coalesce("support", F.lit(0)).cast("bigint"))
        else:
            candidates = open_.withColumn("set", canonical("prefix")).join(known, "set").join(top, ["run_id", "item"])
        last = F.col("lmax") == i + 1
        scored = candidate_quality(candidates, weighted, counts, i, quality, last if forced_last else False, reduce, asymmetric)
        scored = scored.withColumn("logw", share(i) * F.col("q") / 2).withColumn("last", last)
        u = hash_uniform(F.col("seed"), F.lit(i), items_text("prefix"), F.col("item"))
        columns = ["run_id", "path", "prefix", "item", "support", "cnt", "cnts", "bf", "last", "v"]
        keyed = stored(scored.withColumn("v", F.log(F.log(1 / u)) - F.col("logw")).select(columns), "candidates")
        ending, slots = any(r.lmax == i + 1 for r in runs), 2 * most
        while True:
            every = keyed
            if zeros == "class":
                drawn = _class_candidates(open_, keyed, top, i, slots)
                every = keyed.unionByName(stored(drawn.select(columns), "class-draws"))
            if not ending:
                break
            ends, struck = _last_draws(every.where("last").withColumn("itemset", canonical(F.concat("prefix", F.array("item")))), most)
            if zeros == "grid" or struck is None:
                break
            # a branch that has lost so many sets might have had others of the class than those that were drawn
            if not struck.groupBy("run_id", "path").count().where(F.col("count") + most > slots).take(1):
                break
            slots *= 2
        if ending:
            leaves = ends if leaves is None else leaves.unionByName(ends)
        if any(r.lmax > i + 1 for r in runs):
            inner = sampling.smallest(every.where("NOT last"), ["run_id", "path"], F.col("bf"), ["v", "item"], most)
            grown = [F.concat("path", F.array("draw")).alias("path"), F.concat("prefix", F.array("item")).alias("prefix"), F.col("support").alias("sup_prefix"), F.concat("cnts", F.array("cnt")).alias("cnts")]
            level = stored(inner.select("run_id", *grown), "level")
    return leaves


def _class_candidates(open_: DataFrame, keyed: DataFrame, top: DataFrame, level: int, slots: int) -> DataFrame:
    """Of the items that a prefix has in no basket those that may be drawn: as many as ``slots``, with their keys."""
    held = keyed.groupBy("run_id", "path").agg(F.collect_list("item").alias("held"))
    # ni items a run
    lists = top.groupBy("run_id").agg(F.array_sort(F.collect_list("item")).alias("every"), *(F.first(c).alias(c) for c in ("seed", "bf", "lmax")))
    own = open_.join(F.broadcast(lists), "run_id").join(held, ["run_id", "path"], "left")
    rest = F.array_except(F.array_except("every", "prefix"), F.coalesce("held", F.array().cast("array<int>")))
    drawn = sampling.class_draws(own.withColumn("zeros", rest), level, slots)
    return drawn.join(top.select("run_id", "item", "cnt"), ["run_id", "item"]).withColumns({"support": F.lit(0).cast("bigint"), "last": F.col("lmax") == level + 1})


def _last_draws(candidates: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Draws of the last level, where no branch takes a set that an earlier one of its run has taken.

    Every branch picks; where branches meet in a set the earliest keeps it and the others strike it off and pick again. An earlier
    branch never gives a set back, so a few rounds end where one branch after the other would. The second table has what was struck off.
    """
    struck = None
    turn = F.row_number().over(Window.partitionBy("run_id", "itemset").orderBy("path"))
    while True:
        left = candidates if struck is None else candidates.join(struck, ["run_id", "path", "itemset"], "left_anti")
        picked = stored(sampling.smallest(left, ["run_id", "path"], F.col("bf"), ["v", "item"], most).withColumn("turn", turn), "picks")
        lost = picked.where("turn > 1").select("run_id", "path", "itemset")
        if not lost.take(1):
            return picked.select("run_id", F.concat("path", F.array("draw")).alias("path"), "itemset"), struck
        struck = stored(lost if struck is None else struck.unionByName(lost), "struck")


def private_rules_job(baskets: DataFrame, runs: list[Run], quality: str = "sigma", first_item: str = "noisy", forced_last: bool = False, reduce: str | None = None, asymmetric: bool = False, zeros: str = "grid") -> dict[str, DataFrame]:
    """Sets drawn under each run's budget, and what they are worth: leaves, itemsets, rules, stats, histogram, each with run_id.

    ``reduce`` and ``asymmetric`` are those of ``candidate_quality``, ``zeros`` that of ``private_leaves``.

    Only the leaves and the sets in them are private; supports, confidences, histograms and recall are exact and serve evaluation. The
    uniform numbers come from a public hash: for a release take secret seeds.
    """
    counts = stored(items.zero_filled_counts(items.item_counts(baskets)), "counts")
    weighted = stored(items.weighted_baskets(baskets), "weighted")
    with temporary(baskets.sparkSession):
        leaves = kept(private_leaves(weighted, counts, runs, quality, first_item, forced_last, reduce, asymmetric, zeros), "leaves")
    found = stored(itemsets.expand_leaves(leaves, "run_id"), "itemsets")
    every = leaves.select(F.explode(subsets("itemset", proper=False)).alias("itemset")).distinct()
    supports = stored(itemsets.itemset_support(weighted, every, counts), "supports")
    ruled = stored(rules.rules_from_itemsets(found, supports, "run_id"), "rules")
    return {"leaves": leaves, "itemsets": found, "supports": supports, "rules": ruled, "stats": rules.rule_counts(ruled, "run_id"), "histogram": rules.conf_histogram(ruled, "run_id")}


def sweep(baskets: DataFrame, db: str, runs: list[Run], exact: dict[tuple[int, int], DataFrame] | DataFrame | None = None, job: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of the run table for all runs, mined as one ``job``, which may be given. ``exact``, for the real rules and recall: the exact
    stats by (lmax, ni), or the table of ``nested_job``, which has them all."""
    spark = baskets.sparkSession
    job = job or private_rules_job(baskets, runs)
    hist = job["histogram"].groupBy("run_id").agg(F.max(F.when(F.col("bound") == 0, F.col("cum_n"))).alias("rules"), F.max(F.when(F.col("bound") == 0.5, F.col("cum_n"))).alias("rules50"))
    leaves = job["leaves"].groupBy("run_id").agg(F.count("*").alias("leaves"))
    table = spark.createDataFrame([tuple(asdict(r).values()) for r in runs], "run_id int, eps double, epsh double, c0 double, rmax int, nits int, bf int, seed bigint")
    real = None
    if isinstance(exact, DataFrame):
        real, exact = exact.select(F.col("lmax").alias("rmax"), F.col("ni").alias("nits"), F.col("n50").alias("realrls")), None
    for (lmax, ni), stats in (exact or {}).items():
        one = stats.agg(F.sum("n50").alias("realrls")).select(F.lit(lmax).alias("rmax"), F.lit(ni).alias("nits"), "realrls")
        real = one if real is None else real.unionByName(one)
    joined = table.join(leaves, "run_id", "left").join(hist, "run_id", "left")
    joined = joined.join(real, ["rmax", "nits"], "left") if real is not None else joined.withColumn("realrls", F.lit(None).cast("bigint"))
    return joined.select(
        "run_id", F.lit(db).alias("db"), *("eps", "epsh", "c0", "rmax", "nits", "bf", "seed", "leaves", "rules", "rules50"),
        F.try_divide("rules50", "rules").alias("prec50"), "realrls", F.try_divide("rules50", "realrls").alias("recall"),
    )


def rule_quality_job(supports: DataFrame, method: str, m: float, theta: float, eps: float = 0.1, a: float = 1e6, b: float = 1e3) -> DataFrame:
    """Distinct rule points with score and probability of being drawn, best first."""
    return sampling.rules_by_quality(sampling.em_probabilities(rules.rule_points(supports), method, m, theta, eps, a, b), "q")


def best_extension(supports: DataFrame, seed: list[int], size: int, mode: str, c0: float = 0.5) -> DataFrame:
    """(itemset, score): of the sets of that size that contain ``seed`` the one with the best score; ties by itemset."""
    if mode not in ("sigma", "delta", "d"):
        raise ValueError(f"unknown mode {mode}")
    wanted = itemsets.supersets_of(supports, seed, size)
    if mode == "sigma":
        scored = wanted.select("itemset", F.col("support").cast("double").alias("score"))
    else:
        each = wanted.select("itemset", "support", F.explode(subsets("itemset")).alias("part"))
        least = each.join(supports.select(F.col("itemset").alias("part"), F.col("support").alias("s")), "part").groupBy("itemset").agg(F.first("support").alias("support"), F.min("s").alias("least"))
        scored = least.select("itemset", ((F.col("support") if mode == "delta" else F.col("support") / c0) - F.col("least")).alias("score"))
    return scored.orderBy(F.desc("score"), "itemset").limit(1)


def chain_job(supports: DataFrame, n: int, rmax: int, mode: str = "sigma", c0: float = 0.5) -> DataFrame:
    """Greedy growth from the most frequent item to a set of ``rmax``, by sigma, delta or d: (step, itemset, score). Items outside the top
    ``n`` take no part. Mode sigma-d or delta-d: what the first chain ends with is grown on by d, up to the same ``rmax``."""
    if mode not in ("sigma", "delta", "d", "sigma-d", "delta-d"):
        raise ValueError(f"unknown mode {mode}")
    spark = supports.sparkSession
    singles = supports.where(F.size("itemset") == 1).select(F.element_at("itemset", 1).alias("item"), F.col("support").alias("cnt"))
    top = items.item_list(items.top_items(singles, n))
    known = stored(itemsets.itemsets_within(supports, top), "known")
    rows, seed = [], top[:1]
    for part in mode.split("-"):
        for size in range(len(seed) + 1, rmax + 1):
            best = best_extension(known, seed, size, part, c0).first()
            if best is None:
                break
            seed = best["itemset"]
            rows.append((size, seed, float(best["score"])))
    return spark.createDataFrame(rows, "step int, itemset array<int>, score double")


def experiment_report(runs: DataFrame) -> DataFrame:
    """The averaged experiment table of a run table, in the order of its keys. Runs whose log has no complete histogram are left out."""
    return experiments.sorted_report(experiments.average_runs(runs.where("rules IS NOT NULL AND rules50 IS NOT NULL")))


def report_from_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder of run logs: runs, averaged, the two series that are drawn of every configuration, rules by draws (all and those over
    .5) and precision by budget, and the averaged final histograms of each experiment. A log that breaks off is in none of the averages."""
    runs = stored(text.read_run_logs(spark, folder), "runs")
    averaged = stored(experiment_report(runs), "averaged")
    by_draws = averaged.select("db", "eps", "c0", "rmax", "ni", F.col("bf").alias("x"), "R", "R50")
    by_budget = averaged.select("db", "c0", "rmax", "ni", "bf", F.col("eps").alias("x"), "precision", "recall")
    final = stored(text.final_histograms(text.read_log_lines(spark, folder)), "histograms")
    saved = final.groupBy("experiment").agg(F.avg("rules_saved").alias("mean_saved"))  # every run has ten rows
    histograms = experiments.average_histograms(final, ["experiment"], "file", "expected").join(saved, "experiment")
    return {"runs": runs, "averaged": averaged, "by_draws": by_draws, "by_budget": by_budget, "final": final, "histograms": histograms}


def grid_runs(spark: SparkSession, **values: list) -> list[Run]:
    """Runs for all combinations of eps, ratio, c0, lmax, ni, bf and seed."""
    return [Run(**r.asDict()) for r in experiments.param_grid(spark, **values).collect()]
