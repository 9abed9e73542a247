"""One query per operator, over baskets made from the order tables: the brands of each order, and how baskets are sold to customers."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.parameters import rule_space
from marketloom.functions.scalars import div_or_zero, hash_uniform, items_text, laplace_noise, quality_d, rule_quality, subsets
from marketloom.operators import experiments, items, itemsets, nested, rules, sampling
from marketloom.plans import jobs
from marketloom.plans.stored import new_path, stored
from marketloom.sources import tables, text

Query = Callable[[SparkSession, str], DataFrame]
NI, LMAX = 8, 3
#: Runs of the sweep that the experiment queries share.
GRID = {"eps": [0.5, 1.0], "ratio": [0.1], "c0": [0.5], "lmax": [2], "ni": [NI], "bf": [1, 2], "seed": [1, 2]}
#: Runs of three levels.
DEEP = {"eps": [0.5, 2.0], "ratio": [0.1], "c0": [0.5], "lmax": [3], "ni": [6], "bf": [2], "seed": [1, 2]}
#: Runs of nine branches, on wide baskets.
BRANCHES = {"eps": [0.5, 4.0], "ratio": [0.1], "c0": [0.5], "lmax": [3], "ni": [25], "bf": [3], "seed": [1]}
#: Runs over several numbers of items.
RANGES = {"eps": [0.5], "ratio": [0.1], "c0": [0.5], "lmax": [2], "ni": [5, 10, 15, 20, 25], "bf": [2], "seed": [1]}
#: Runs over items most of whose pairs are in no basket.
SPARSE = {"eps": [0.5, 4.0], "ratio": [0.1], "c0": [0.5], "lmax": [2], "ni": [60], "bf": [2], "seed": [1, 2, 3]}
#: The run whose log breaks off.
BROKEN = 7
THETA = 500.0


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _brands(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"\d+", 0).cast("int")
    return _read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), number.alias("item"))


#: The baskets that the query being built has asked for, each stored once.
_held: ContextVar[dict | None] = ContextVar("held", default=None)


def _once(build: Query) -> Query:
    """Within a query the table is built once and stored."""

    @wraps(build)
    def get(spark: SparkSession, d: str) -> DataFrame:
        held = _held.get()
        if held is None:
            return build(spark, d)
        if build not in held:
            held[build] = stored(build(spark, d), "baskets")
        return held[build]

    return get


def _holding(query: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        token = _held.set({})
        try:
            return query(spark, d)
        finally:
            _held.reset(token)

    return run


@_once
def order_baskets(spark: SparkSession, d: str) -> DataFrame:
    """The brands of each order."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_brands(spark, d), "l_partkey")
    return tables.baskets_from_table(lines, "l_orderkey", "item")


@_once
def customer_baskets(spark: SparkSession, d: str) -> DataFrame:
    """The brands that each customer has ever ordered: few wide baskets."""
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_brands(spark, d), "l_partkey").join(orders, "l_orderkey")
    return tables.baskets_from_table(lines, "o_custkey", "item")


def _name(c: str) -> Column:
    return items_text(c).alias(c)


def _r(c: str | Column, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def _exact(spark: SparkSession, d: str, lmax: int = LMAX) -> dict[str, DataFrame]:
    return jobs.exact_rules_job(order_baskets(spark, d), lmax, NI)


def _runs(spark: SparkSession) -> list[jobs.Run]:
    return jobs.grid_runs(spark, **GRID)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return items.item_counts(order_baskets(spark, d))


# sources, items


def basket_lines(spark: SparkSession, d: str) -> DataFrame:
    """Baskets written as text lines and parsed again: sizes of baskets."""
    parsed = text.parse_baskets(order_baskets(spark, d).select(items_text("items").alias("value")))
    return parsed.groupBy(F.size("items").alias("size")).agg(F.count("*").alias("n"))


def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    return items.zero_filled_counts(_counts(spark, d).withColumn("item", F.col("item") * 2))


def rank_sorted_baskets(spark: SparkSession, d: str) -> DataFrame:
    b = order_baskets(spark, d)
    return items.rank_sort_baskets(b, items.item_ranks(items.item_counts(b))).select("tid", _name("items"))


def restricted_baskets(spark: SparkSession, d: str) -> DataFrame:
    b = order_baskets(spark, d)
    top = items.item_list(items.top_items(items.item_counts(b), NI))
    return items.restrict_to_items(b, top).select("tid", _name("items"))


def restricted_to_table(spark: SparkSession, d: str) -> DataFrame:
    b = order_baskets(spark, d)
    return items.restrict_to_table(b, items.top_items(items.item_counts(b), NI)).select("tid", _name("items"))


def weighted_baskets(spark: SparkSession, d: str) -> DataFrame:
    return items.weighted_baskets(order_baskets(spark, d)).select(_name("items"), "w")


# itemsets


def _supports(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    b = order_baskets(spark, d)
    top = items.item_list(items.top_items(items.item_counts(b), NI))
    return itemsets.enumerate_itemsets(items.weighted_baskets(items.restrict_to_items(b, top)), top, LMAX, strategy)


def enumerated(strategy: str, spark: SparkSession, d: str) -> DataFrame:
    return _supports(spark, d, strategy).select(_name("itemset"), "support")


def dense_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two and three of all brands, in wide baskets."""
    weighted = items.weighted_baskets(customer_baskets(spark, d))
    every = items.item_list(items.top_items(items.item_counts(customer_baskets(spark, d)), 25))
    return itemsets.enumerate_itemsets(weighted, every, 3).select(_name("itemset"), "support")


@_once
def customer_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts that each customer has ever ordered: wide baskets of many items."""
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return tables.baskets_from_table(_read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey"), "o_custkey", "l_partkey")


def vertical_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two and three of the 200 most frequent parts, counted by vertical bitmaps."""
    baskets = customer_parts(spark, d)
    top = items.item_list(items.top_items(items.item_counts(baskets), 200))
    return itemsets.enumerate_itemsets(items.weighted_baskets(items.restrict_to_items(baskets, top)), top, 3, "vertical").select(_name("itemset"), "support")


def many_supports(spark: SparkSession, d: str) -> DataFrame:
    """Supports of all pairs and single ones of 160 parts, so many that they go to the baskets as a trie."""
    baskets = customer_parts(spark, d)
    counts = items.item_counts(baskets)
    top = stored(items.top_items(counts, 160).select("item"), "top")
    pairs = top.join(F.broadcast(top.select(F.col("item").alias("other"))), F.col("item") <= F.col("other"))  # of 160 rows
    sets = pairs.select(F.array_distinct(F.array("item", "other")).alias("itemset"))
    return itemsets.itemset_support(items.weighted_baskets(baskets), sets, counts).select(_name("itemset"), "support")


def itemset_support(spark: SparkSession, d: str) -> DataFrame:
    """Supports of every top item with each of the next two, and with one that does not exist."""
    counts = _counts(spark, d)
    top = items.item_ranks(counts).where(F.col("rank") <= NI)
    sets = top.select(F.array("item", F.col("item") % 25 + 1, F.lit(99)).alias("itemset")).unionByName(top.select(F.array("item", F.col("item") % 25 + 1).alias("itemset")))
    return itemsets.itemset_support(items.weighted_baskets(order_baskets(spark, d)), sets, counts).select(_name("itemset"), "support")


def extended_prefixes(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    top = items.top_items(counts, NI)
    prefixes = items.top_items(counts, 2).select(F.array("item").alias("prefix"))
    return itemsets.extend_prefixes(items.weighted_baskets(order_baskets(spark, d)), prefixes, top, counts).select(_name("prefix"), "item", "support")


def itemsets_within(spark: SparkSession, d: str) -> DataFrame:
    top = items.item_list(items.top_items(_counts(spark, d), 4))
    return itemsets.itemsets_within(_exact(spark, d)["supports"], top).select(_name("itemset"), "support")


def supersets_of(spark: SparkSession, d: str) -> DataFrame:
    top = items.item_list(items.top_items(_counts(spark, d), 1))
    return itemsets.supersets_of(_exact(spark, d)["supports"], top, 3).select(_name("itemset"), "support")


def expanded_leaves(spark: SparkSession, d: str) -> DataFrame:
    leaves = _exact(spark, d)["supports"].where(F.size("itemset") == 3)
    return itemsets.expand_leaves(leaves).select(_name("itemset"))


def unseen_itemsets(spark: SparkSession, d: str) -> DataFrame:
    job = _exact(spark, d)
    pairs = job["supports"].where(F.size("itemset") == 2)
    seen = rules.confident_rules(job["rules"], 0.2).where(F.size("itemset") == 2)
    return itemsets.unseen(pairs, seen).select(_name("itemset"))


def unseen_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Of each run the pairs of frequent items that it has not drawn."""
    leaves = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["leaves"]
    pairs = _exact(spark, d, 2)["supports"].where(F.size("itemset") == 2).select("itemset")
    candidates = pairs.join(F.broadcast(experiments.param_grid(spark, **GRID).select(F.col("run_id").cast("int").alias("run_id"))))  # of 8 runs
    return itemsets.unseen(candidates, leaves, "run_id").select("run_id", _name("itemset"))


# rules


def _named_rules(df: DataFrame) -> DataFrame:
    return df.select(_name("itemset"), _name("antecedent"), _name("consequent"), "sup_ab", "sup_a", _r("conf").alias("conf"))


def all_rules(spark: SparkSession, d: str) -> DataFrame:
    return _named_rules(_exact(spark, d)["rules"])


def confident(spark: SparkSession, d: str) -> DataFrame:
    return _named_rules(rules.confident_rules(_exact(spark, d)["rules"], 0.15))


def nonzero(spark: SparkSession, d: str) -> DataFrame:
    return rules.nonzero_conf(_exact(spark, d)["rules"]).groupBy(F.size("itemset").alias("size")).agg(F.count("*").alias("n"))


def exact_stats(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d)["stats"].select(_name("itemset"), "support", "n30", "n50", "n70")


def stored_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rule counts per itemset stored under their parameters, beside others, and loaded again."""
    path = new_path(spark, "itemset-stats")
    tables.save_itemset_stats(_exact(spark, d, 2)["stats"], path, 2, NI)
    tables.save_itemset_stats(_exact(spark, d)["stats"], path, LMAX, NI)
    return tables.load_itemset_stats(spark, path, LMAX, NI).select(_name("itemset"), "support", "n30", "n50", "n70")


def replaced_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts that were stored under parameters that had others, then some, then none before: what each load gives."""
    path, stats = new_path(spark, "itemset-stats"), stored(_exact(spark, d)["stats"], "stats")
    pairs = stats.where(F.size("itemset") == 2)
    for kept, lmax in ((stats, 2), (pairs, 2), (pairs, 3), (stats.where("false"), 3), (stats.where("false"), 4), (stats, 4)):
        tables.save_itemset_stats(kept, path, lmax, NI)
    loaded = [tables.load_itemset_stats(spark, path, lmax, NI).select(F.lit(lmax).alias("lmax"), _name("itemset"), "support", "n30", "n50", "n70") for lmax in (2, 3, 4)]
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2])


def nested_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The exact totals for 5 to 25 items and sets of up to 2 and 3, from one enumeration."""
    return jobs.nested_job(order_baskets(spark, d), 3, 25).where("ni >= 5")


def nested_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of runs with five numbers of items against the totals of one enumeration."""
    runs = jobs.grid_runs(spark, **RANGES)
    job = jobs.private_rules_job(order_baskets(spark, d), runs)
    totals = jobs.nested_job(order_baskets(spark, d), 2, max(RANGES["ni"]))
    return nested.nested_recall(job["stats"], experiments.param_grid(spark, **RANGES), totals).withColumn("recall", _r("recall"))


def conf_range(spark: SparkSession, d: str) -> DataFrame:
    return rules.conf_range(_exact(spark, d)["rules"]).select(_r("min_conf").alias("min_conf"), _r("max_conf").alias("max_conf"))


def _hist(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "bin", "bound", "n", _r("frac").alias("frac"), "cum_n", _r("cum_frac").alias("cum_frac"))


def conf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _hist(rules.conf_histogram(_exact(spark, d)["rules"]))


def parsed_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The histogram written as text lines and parsed again."""
    return text.parse_histogram_lines(text.histogram_lines(rules.conf_histogram(_exact(spark, d)["rules"]))).select("bound", "n", "cum_n")


def rule_points(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_points(_exact(spark, d)["supports"]).select(_name("itemset"), _name("antecedent"), "sup_a", "sup_ab", "len_a", "len_ab")


def rule_points_improper(spark: SparkSession, d: str) -> DataFrame:
    points = rules.rule_points(_exact(spark, d)["supports"], rmax=2, proper=False)
    return points.select(_name("itemset"), _name("antecedent"), "sup_a", "sup_ab", "len_a", "len_ab")


def rule_count_of_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_count_of_itemsets(_exact(spark, d)["supports"])


def lattice_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.lattice_check(_exact(spark, d)["supports"])


def rule_lines(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d)["rules"].select(text.format_rule().alias("value"))


def distinct_rule_digits(spark: SparkSession, d: str) -> DataFrame:
    return rules.distinct_rule_digits(rule_lines(spark, d))


def itemset_lines(spark: SparkSession, d: str) -> DataFrame:
    """Supports written as a list of lines and parsed again, pairs and single items only."""
    return text.parse_itemset_supports(text.format_itemset_supports(_exact(spark, d)["supports"]), rmax=2).select(_name("itemset"), "support")


def rules_space(spark: SparkSession, d: str) -> DataFrame:
    """Possible rules of all items of the baskets, and those of them that occur."""
    n = _counts(spark, d).count()
    return _exact(spark, d)["rules"].agg(F.count("*").alias("n_rules")).select(F.lit(rule_space(n, LMAX)).cast("bigint").alias("possible"), "n_rules")


# privacy and sampling


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    return sampling.noisy_items(items.zero_filled_counts(_counts(spark, d)), 0.05, 42)


def _shown(noisy: DataFrame) -> DataFrame:
    return noisy.select("item", "real_count", _r("noisy_count").alias("noisy_count"), "pos")


def noisy_items(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_noisy(spark, d))


def above_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return _shown(sampling.above_noise_floor(_noisy(spark, d), 0.05, scale=120.0))


def top_noisy_items(spark: SparkSession, d: str) -> DataFrame:
    return _shown(sampling.top_noisy_items(_noisy(spark, d), NI))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Uniform, noise, ratio and subsets of the counted items."""
    u = hash_uniform(7, F.col("item"))
    return _counts(spark, d).select("item", _r(u, 12).alias("u"), _r(laplace_noise(u, 2.0)).alias("noise"), _r(div_or_zero(F.col("cnt"), F.col("item") % 2)).alias("ratio"), F.array_join(F.transform(subsets(F.array("item", F.col("item") + 1, F.col("item") + 2)), lambda s: items_text(s)), "/").alias("parts"))


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three of the partners of each top item, drawn by joint support."""
    pairs = _supports(spark, d, "explode").where(F.size("itemset") == 2).select(F.col("itemset")[0].alias("a"), F.col("itemset")[1].alias("item"), "support")
    drawn = sampling.weighted_sample(pairs, ["a"], 3, "support", hash_uniform(5, F.col("a"), F.col("item")), ["item"])
    return drawn.select("a", "item", "draw", _r("v", 9).alias("v"))


def extension_qualities(spark: SparkSession, d: str) -> DataFrame:
    """Scores sigma, delta and d of every pair, prefix first."""
    counts = _counts(spark, d)
    top = items.top_items(counts, NI)
    found = itemsets.extend_prefixes(items.weighted_baskets(order_baskets(spark, d)), top.select(F.array("item").alias("prefix")), top, counts)
    whole = found.join(counts, "item").join(counts.select(F.array("item").alias("prefix"), F.col("cnt").alias("sup_prefix")), "prefix")
    scored = [sampling.extension_quality(whole, m).select(_name("prefix"), "item", F.lit(m).alias("method"), _r("q").alias("q")) for m in ("sigma", "delta", "d")]
    lack = whole.select(_name("prefix"), "item", F.lit("d asymmetric").alias("method"), _r(quality_d("support", "cnt", 0.5, True)).alias("q"))
    return scored[0].unionByName(scored[1]).unionByName(scored[2]).unionByName(lack)


def reduced_delta(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reduced_delta(_exact(spark, d)["supports"]).select(_name("itemset"), "q")


def rule_qualities(spark: SparkSession, d: str) -> DataFrame:
    """The seven scores of every distinct rule point."""
    points = rules.rule_points(_exact(spark, d)["supports"]).select("sup_a", "sup_ab").distinct()
    m = float(order_baskets(spark, d).count())
    return points.select("sup_a", "sup_ab", *(_r(rule_quality("sup_a", "sup_ab", k, m, THETA)).alias(k) for k in ("mt", "tt", "aab", "amab", "aabtab", "exp", "xy")))


def em_probabilities(spark: SparkSession, d: str) -> DataFrame:
    m = float(order_baskets(spark, d).count())
    return jobs.rule_quality_job(_exact(spark, d)["supports"], "mt", m, THETA, eps=0.01).select("sup_a", "sup_ab", _r("q").alias("q"), _r("p").alias("p"))


def chain(mode: str, spark: SparkSession, d: str) -> DataFrame:
    return jobs.chain_job(_exact(spark, d)["supports"], NI, LMAX, mode).select("step", _name("itemset"), "score")


def private_leaves(spark: SparkSession, d: str) -> DataFrame:
    return jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["leaves"].select("run_id", _name("itemset"))


def private_rules(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["rules"]
    return found.select("run_id", _name("itemset"), _name("antecedent"), "sup_ab", "sup_a", _r("conf").alias("conf"))


def private_three(spark: SparkSession, d: str, **options) -> DataFrame:
    """Sets of three levels with two draws each: four branches, which meet at the last level."""
    return jobs.private_rules_job(order_baskets(spark, d), jobs.grid_runs(spark, **DEEP), **options)["leaves"].select("run_id", _name("itemset"))


@_once
def order_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each order: of most pairs no basket holds both."""
    return tables.baskets_from_table(_read(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def private_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two of 60 parts, those that no order has drawn as one class."""
    job = jobs.private_rules_job(order_parts(spark, d), jobs.grid_runs(spark, **SPARSE), zeros="class")
    return job["leaves"].select("run_id", _name("itemset"))


def private_branches(spark: SparkSession, d: str) -> DataFrame:
    """Sets of three levels with three draws each, on wide baskets: nine branches, which meet at the last level."""
    return jobs.private_rules_job(customer_baskets(spark, d), jobs.grid_runs(spark, **BRANCHES))["leaves"].select("run_id", _name("itemset"))


def private_deep(spark: SparkSession, d: str) -> DataFrame:
    """Three levels with four draws each, on wide baskets; clashes at the last level included."""
    run = jobs.Run(run_id=0, eps=0.5, ratio=0.01, c0=0.5, lmax=3, ni=25, bf=4, seed=42)
    return jobs.private_rules_job(customer_baskets(spark, d), [run])["stats"].select(_name("itemset"), "n30", "n50", "n70")


def private_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _hist(jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["histogram"], "run_id")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    private = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["stats"].where("run_id = 2").drop("run_id")
    return rules.merge_real_private(_exact(spark, d, 2)["stats"], private)


def merge_real_private(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).withColumn("itemset", items_text("itemset"))


def recall_report(spark: SparkSession, d: str) -> DataFrame:
    return rules.recall_report(_merged(spark, d)).withColumn("recall", _r("recall"))


def estimated_recall(spark: SparkSession, d: str) -> DataFrame:
    job = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))
    own = {k: job[k].where("run_id = 2").drop("run_id") for k in ("histogram", "stats")}
    return rules.estimated_recall(own["histogram"], own["stats"], NI, 2).withColumn("recall", _r("recall"))


# experiments


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    exact = {(2, NI): _exact(spark, d, 2)["stats"]}
    return jobs.sweep(order_baskets(spark, d), "orders.brand", _runs(spark), exact)


def sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d).withColumns({"prec50": _r("prec50"), "recall": _r("recall")})


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The sweep as lines of run logs, one file for each run."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    call = F.concat_ws(" ", F.lit("./dph data/orders.brand.dat real.dat"), *(F.col(c).cast("string") for c in ("eps", "epsh", "c0", "rmax", "nits", "bf", "seed")))
    lines = F.array(
        F.lit("Called with: argc=10"), call, F.concat(F.lit("Total leaves "), zero("leaves")), F.lit("Total time:  0.50"),
        F.concat(F.lit("\t0.50\t0\t0.00\t"), zero("rules50"), F.lit("\t0.00")), F.concat(F.lit("\t0.00\t0\t0.00\t"), zero("rules"), F.lit("\t1.00")),
        F.concat(F.lit("Real   :   1   "), zero("realrls"), F.lit("   1")), F.lit("Recall :   0.10   0.25   0.10"),
    )
    return _sweep(spark, d).select(F.concat(F.lit("logs/run_"), F.col("run_id").cast("string")).alias("file"), F.explode(lines).alias("value"))


def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """The sweep written as run logs and parsed again."""
    return text.parse_run_logs(_log_lines(spark, d)).withColumns({"tpl": _r("tpl"), "prec50": _r("prec50")})


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """The run table written as text and read again."""
    path = new_path(spark, "run-table")
    text.write_runs(text.parse_run_logs(_log_lines(spark, d)).drop("file"), path)
    return text.read_runs(spark, path, sep="\t").withColumns({"tpl": _r("tpl"), "prec50": _r("prec50")})


def experiment_report(spark: SparkSession, d: str) -> DataFrame:
    """The averaged table of a folder of log files."""
    path = new_path(spark, "logs")
    lines = _log_lines(spark, d).withColumn("run", F.col("file"))
    lines.repartition("run").select("run", "value").write.partitionBy("run").text(path)
    return jobs.report_from_logs(spark, path)["averaged"].withColumns({c: _r(c) for c in ("R", "R50", "RR", "precision", "recall")})


def _log_folder(spark: SparkSession, d: str) -> str:
    """A folder of whole logs of the sweep, one for each run, of which one breaks off within its histogram."""
    job = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))
    ran = jobs.sweep(order_baskets(spark, d), "orders.brand", _runs(spark), {(2, NI): _exact(spark, d, 2)["stats"]}, job)
    name = F.format_string("orders_eps_%s_seed_%d_sh_%d_bins_%d", F.col("eps").cast("string"), "seed", "rmax", "bf")
    runs = stored(ran.withColumn("run", name), "runs")
    hist = job["histogram"].join(runs.select("run_id", "run"), "run_id")
    logs = text.format_run_logs(runs, hist).join(runs.where(F.col("run_id") == BROKEN).select(F.col("run").alias("broken")), F.col("run") == F.col("broken"), "left")
    begin = F.regexp_extract("value", r"(?s)^(.*\n\t0\.50\t *\d+\t)", 1)
    path = new_path(spark, "logs")
    text.write_run_logs(logs.withColumn("value", F.when(F.col("broken").isNull(), F.col("value")).otherwise(begin)), path)
    return path


def log_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Averaged final histograms of whole logs that were written and read again."""
    found = jobs.report_from_logs(spark, _log_folder(spark, d))["histograms"]
    number = lambda i, kind: F.get(F.split("experiment", "\t"), F.lit(i)).cast(kind)
    return found.select(number(1, "double").alias("eps"), number(6, "int").alias("bf"), "bound", "runs", "mean_saved", "mean_total", "mean_cum", _r("of_total").alias("of_total"), _r("of_expected").alias("of_expected"))


def _log_matrix(spark: SparkSession, d: str) -> DataFrame:
    return experiments.layer_bin_matrix(jobs.report_from_logs(spark, _log_folder(spark, d))["final"], 4)


def log_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean counts by shelves and bins, which the names of the logs say, from their final histograms."""
    return _log_matrix(spark, d)


def log_matrix_series(spark: SparkSession, d: str) -> DataFrame:
    """The series of one bound of that matrix, where all ten bins are there."""
    return experiments.complete_series(experiments.matrix_to_series(_log_matrix(spark, d), 0.5), ["shelves"], 10)


def log_series(key: str, spark: SparkSession, d: str) -> DataFrame:
    """What is drawn of the averaged table of the logs: rules by draws, or precision and recall by budget."""
    found = jobs.report_from_logs(spark, _log_folder(spark, d))[key]
    return found.withColumns({c: _r(c) for c in ("R", "R50", "precision", "recall") if c in found.columns})


def _averaged(spark: SparkSession, d: str) -> DataFrame:
    return jobs.experiment_report(_sweep(spark, d))


def average_runs(spark: SparkSession, d: str) -> DataFrame:
    return _averaged(spark, d).withColumns({c: _r(c) for c in ("R", "R50", "RR", "precision", "recall")})


def series(spark: SparkSession, d: str) -> DataFrame:
    return experiments.series(_averaged(spark, d), "orders", 0.5, 0.5, 2, "ni", NI, "bf", "R").withColumn("y", _r("y"))


def good_vs_all(spark: SparkSession, d: str) -> DataFrame:
    return experiments.good_vs_all(_averaged(spark, d), "brand", 2).select(_r("R").alias("R"), _r("R50").alias("R50"))


def precision_vs_k(spark: SparkSession, d: str) -> DataFrame:
    table = _sweep(spark, d).where("seed = 1 AND eps = 0.5").select("db", "eps", "c0", "rmax", F.lit(1).alias("alpha"), F.col("bf").alias("k"), F.col("prec50").alias("precision"))
    return experiments.precision_vs_k(table, "orders", 2).withColumn("precision", _r("precision"))


def _precisions(spark: SparkSession, d: str) -> DataFrame:
    """The precision table of the sweep's runs with seed 1."""
    hist = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["histogram"]
    at = lambda b: F.max(F.when(F.col("bound") == b, F.col("cum_frac")))
    wide = hist.groupBy("run_id").agg(at(0.9).alias("p90"), at(0.7).alias("p70"), at(0.5).alias("p50"))
    grid = experiments.param_grid(spark, **GRID).where("seed = 1")
    return grid.join(wide, "run_id").select(F.lit("orders").alias("dataset"), F.col("lmax").alias("length"), F.col("bf").alias("k"), "eps", "p90", "p70", "p50")


def precision_vs_eps(spark: SparkSession, d: str) -> DataFrame:
    return experiments.precision_vs_eps(_precisions(spark, d), "orders", 2, 2).select("eps", *(_r(c).alias(c) for c in ("p90", "p70", "p50")))


def precision_by_k(spark: SparkSession, d: str) -> DataFrame:
    return experiments.precision_by_k(_precisions(spark, d), "orders", 2).select("k", *(_r(c).alias(c) for c in ("p90", "p70", "p50")))


def with_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Runs with two draws against those with one of the same seed, of which seed 2 has no baseline; series of two eps values only."""
    runs = _sweep(spark, d).select("db", "seed", "bf", "eps", "rules")
    both = experiments.with_baseline(runs.where("bf = 2"), runs.where("bf = 1 AND seed = 1"), "db", "seed")
    return experiments.complete_series(both, ["db", "seed", "method"], 2)


def _run_histograms(spark: SparkSession, d: str) -> DataFrame:
    hist = jobs.private_rules_job(order_baskets(spark, d), _runs(spark))["histogram"]
    return hist.join(experiments.param_grid(spark, **GRID), "run_id")


def average_histograms(spark: SparkSession, d: str) -> DataFrame:
    found = experiments.average_histograms(_run_histograms(spark, d).withColumn("expected", F.lit(100)), ["eps", "bf"], "seed", "expected")
    return found.select("eps", "bf", "bound", "runs", "mean_total", "mean_cum", _r("of_total").alias("of_total"), _r("of_expected").alias("of_expected"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    name = F.format_string("logs/orders_seed_%d_sh_%d_bins_%d", F.col("seed"), F.col("lmax"), F.col("bf"))
    return experiments.layer_bin_matrix(_run_histograms(spark, d).where("eps = 0.5").withColumn("file", name), 2)


def layer_bin_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


def matrix_series(spark: SparkSession, d: str) -> DataFrame:
    return experiments.matrix_to_series(_matrix(spark, d), 0.0)


QUERIES: dict[str, Query] = {
    "item_counts": _counts,
    "item_ranks": lambda s, d: items.item_ranks(_counts(s, d)),
    "top_items": lambda s, d: items.top_items(_counts(s, d), NI),
    "basket_profile": lambda s, d: items.basket_profile(order_baskets(s, d)),
    "itemset_enumeration": partial(enumerated, "explode"),
    "itemset_enumeration_bitmap": partial(enumerated, "bitmap"),
    "rules": all_rules,
    "confident_rules": confident,
    "nonzero_conf": nonzero,
    "best_extension_sigma": partial(chain, "sigma"),
    "best_extension_delta": partial(chain, "delta"),
    "best_extension_d": partial(chain, "d"),
    "best_extension_sigma_d": partial(chain, "sigma-d"),
    "best_extension_delta_d": partial(chain, "delta-d"),
    "private_three_delta": partial(private_three, quality="delta", reduce="max"),
    "private_three_d": partial(private_three, quality="d", reduce="min", asymmetric=True, first_item="em"),
    "log_series_by_draws": partial(log_series, "by_draws"),
    "log_series_by_budget": partial(log_series, "by_budget"),
    "private_three_last": partial(private_three, quality="sigma", forced_last=True),
    **{
        f.__name__: f
        for f in (
            basket_lines, zero_filled_counts, rank_sorted_baskets, restricted_baskets, restricted_to_table, weighted_baskets, dense_itemsets, itemset_support,
            extended_prefixes, itemsets_within, supersets_of, expanded_leaves, unseen_itemsets, exact_stats, stored_stats, conf_range, conf_histogram, parsed_histogram,
            rule_points, rule_points_improper, rule_count_of_itemsets, lattice_check, rule_lines, distinct_rule_digits, itemset_lines, rules_space,
            noisy_items, above_noise_floor, top_noisy_items, scalar_functions, weighted_sample, extension_qualities, reduced_delta, rule_qualities,
            em_probabilities, private_leaves, private_rules, private_three, private_deep, private_histogram, merge_real_private, recall_report, estimated_recall, sweep,
            run_logs, run_table, experiment_report, average_runs, series, good_vs_all, precision_vs_k, precision_vs_eps, precision_by_k, with_baseline, average_histograms,
            layer_bin_matrix, matrix_series,
            replaced_stats, nested_thresholds, nested_recall, vertical_itemsets, many_supports, unseen_by_run, private_sparse, private_branches, log_histograms, log_matrix, log_matrix_series,
        )
    },
}
#: Those that need the baskets more than once.
_SEVERAL = set(QUERIES) - {"item_counts", "item_ranks", "top_items", "basket_lines", "weighted_baskets", "zero_filled_counts", "noisy_items", "above_noise_floor", "top_noisy_items", "scalar_functions"}
QUERIES |= {k: _holding(q) for k, q in QUERIES.items() if k in _SEVERAL}
