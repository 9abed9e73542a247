"""Operators against values worked out by hand or by brute force."""

import math
import random
from itertools import combinations

import pytest
from fixtures import K5, T10
from pyspark.sql import functions as F

from marketloom.functions.parameters import budget, rule_space
from marketloom.functions.scalars import dataset_name, div_or_zero, hash_uniform, laplace_noise, name_part, subsets
from marketloom.operators import experiments, items, itemsets, rules, sampling
from marketloom.plans import jobs
from marketloom.sources import tables, text


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.fixture(scope="module")
def t10(spark):
    return text.parse_baskets(lines(spark, T10)).cache()


@pytest.fixture(scope="module")
def k5(spark):
    return text.parse_itemset_supports(lines(spark, K5)).cache()


def test_counts_ranks_profile(spark, t10):
    counts = items.item_counts(t10)
    assert dict(items.zero_filled_counts(counts).collect()) == {2: 7, 3: 6, 1: 5, 4: 3, 6: 2, 5: 0}
    ranked = items.item_ranks(items.zero_filled_counts(counts)).orderBy("rank")
    assert [r["item"] for r in ranked.collect()] == [2, 3, 1, 4, 6, 5]
    assert items.basket_profile(t10).first().asDict() == {"t": 10, "n": 6, "depth": 5, "nodes": 12}
    assert [r["item"] for r in items.top_items(counts, 2).collect()] == [2, 3]


@pytest.mark.parametrize(("ni", "totals"), [(3, (12, 10, 5)), (4, (28, 17, 9))])
@pytest.mark.parametrize("strategy", ["explode", "bitmap", "auto"])
def test_exact_job(t10, ni, totals, strategy):
    stats = jobs.exact_rules_job(t10, 3, ni, strategy)["stats"]
    assert tuple(stats.agg(F.sum("n30"), F.sum("n50"), F.sum("n70")).first()) == totals
    if ni == 3:
        assert {tuple(r["itemset"]): tuple(r)[1:] for r in stats.collect()} == {(1, 2): (4, 2, 2, 1), (1, 3): (4, 2, 2, 1), (2, 3): (4, 2, 2, 0), (1, 2, 3): (3, 6, 4, 3)}


def test_odd_lines(spark, tmp_path):
    path = tmp_path / "baskets.txt"
    path.write_text("1 1 2\n0 3\nx 4\n" + " ".join(map(str, range(1, 1500))) + "\n\n7 8")
    got = sorted(r["items"] for r in text.read_baskets(spark, str(path)).collect())
    assert got == sorted([[1, 2], [3], [4], list(range(1, 1500)), [], [7, 8]])
    with pytest.raises(Exception, match="not an item"):
        text.read_baskets(spark, str(path), strict=True).collect()
    empty = text.parse_baskets(lines(spark, []))
    assert items.item_counts(empty).count() == 0
    assert items.zero_filled_counts(items.item_counts(empty)).count() == 0


def test_k5(spark, k5):
    assert rules.lattice_check(k5).first().asDict() == {"n_items": 5, "n_itemsets": 31, "n_rules": 180, "complete": True}
    found = rules.rules_from_itemsets(k5, k5, strict=True).cache()
    assert [r["n"] for r in rules.conf_histogram(found).orderBy("bin").collect()] == [8, 8, 4, 8, 3, 29, 17, 25, 39, 39]
    assert tuple(rules.rule_counts(found).agg(F.sum("n30"), F.sum("n50"), F.sum("n70")).first()) == (77, 31, 20)
    assert tuple(rules.conf_range(found).first()) == (0.018442766065709524, 0.9929430011632415)
    best = jobs.rule_quality_job(k5, "xy", 990002, 87743, 0.1).take(2)
    assert [(r["sup_a"], r["sup_ab"], r["q"]) for r in best] == [(601374, 86092, pytest.approx(256345.56576770084)), (601374, 77675, pytest.approx(253949.78355494374))]
    assert best[0]["p"] == 1.0


CHAINS = {
    "sigma": [([6, 11], 324013), ([3, 6, 11], 143682), ([1, 3, 6, 11], 37743), ([1, 3, 6, 11, 218], 11091)],
    "delta": [([6, 218], -10923), ([6, 11, 218], -1026), ([1, 6, 11, 218], -182), ([1, 3, 6, 11, 218], -85)],
    "d": [([6, 11], 283961), ([3, 6, 11], 126078), ([1, 3, 6, 11], 35218), ([1, 3, 6, 11, 218], 11006)],
}


@pytest.mark.parametrize("mode", CHAINS)
def test_chains(k5, mode):
    assert [(list(r["itemset"]), r["score"]) for r in jobs.chain_job(k5, 5, 5, mode).orderBy("step").collect()] == CHAINS[mode]


def test_missing_subsets(k5):
    part = k5.where("size(itemset) != 2")
    assert not rules.lattice_check(part).first()["complete"]
    with pytest.raises(Exception, match="no support of"):
        rules.rule_points(part).collect()
    assert rules.rules_from_itemsets(part, part).where("sup_a IS NULL").count() > 0


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(hash_uniform(42, 0, 6)).first()[0] == 0.8970097811723686
    assert one.select(subsets(F.array(F.lit(3), F.lit(6), F.lit(11)))).first()[0] == [[3], [6], [3, 6], [11], [3, 11], [6, 11]]
    assert one.select(subsets(F.array(F.lit(3)))).first()[0] == []
    pairs = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)], "a double, b double")
    assert [r[0] for r in pairs.select(div_or_zero("a", "b")).collect()] == [0.0, math.inf, 0.0]
    edges = spark.createDataFrame([(c,) for c in (0.0, 0.3, 0.1, 1.0)], "conf double")
    assert {r["bound"]: r["n"] for r in rules.conf_histogram(edges).where("n > 0").collect()} == {0.2: 1, 0.0: 1, 0.9: 1}
    name = spark.createDataFrame([("x/mushroom.dat.gz", "logs/db_seed_1_sh_4_bins_10")], "a string, b string")
    assert tuple(name.select(dataset_name("a"), name_part("b", 3), name_part("b", 1)).first()) == ("mushroom", "4", "10")


def test_parameters():
    assert [rule_space(n, 5) for n in (5, 6, 7, 8)] == [180, 540, 1372, 3052]
    assert rule_space(5, 3) == 80
    b = budget(1.0, 0.1, 3, 2)
    assert b["levels"] == {1: pytest.approx(0.225), 2: pytest.approx(0.1125)}
    assert budget(1.0, 0.1, 3, 2, "em")["levels"] == {0: pytest.approx(0.3), 1: pytest.approx(0.15), 2: pytest.approx(0.075)}
    for bad in ((0, 0.1, 3, 2), (1, 0, 3, 2), (1, 0.1, 1, 2)):
        with pytest.raises(ValueError, match="must be"):
            budget(*bad)
    with pytest.raises(ValueError, match="lmax"):
        jobs.Run(0, 1.0, 0.1, 0.5, 8, 5, 2)


def test_noise_and_draws(spark):
    many = spark.range(20_000)
    mean, var = many.select(laplace_noise(hash_uniform(3, F.col("id")), 2.0).alias("x")).agg(F.avg("x"), F.variance("x")).first()
    assert abs(mean) < 0.1
    assert var == pytest.approx(8, rel=0.1)
    grid = spark.range(5_000).crossJoin(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "item int, w double"))
    first = sampling.weighted_sample(grid, ["id"], 1, "w", hash_uniform(1, F.col("id"), F.col("item")), ["item"])
    share = {r["item"]: r["count"] / 5_000 for r in first.groupBy("item").count().collect()}
    assert share[3] == pytest.approx(5 / 8, abs=0.03)
    logs = sampling.weighted_sample(grid.withColumn("lw", F.log("w")), ["id"], 1, "lw", hash_uniform(1, F.col("id"), F.col("item")), ["item"], log_weight=True)
    assert sorted(logs.select("id", "item").collect()) == sorted(first.select("id", "item").collect())


def test_support_and_extensions_by_brute_force(spark):
    rng = random.Random(1)
    baskets = [sorted(rng.sample(range(1, 13), rng.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "tid long, items array<int>")
    counts, weighted = items.item_counts(df), items.weighted_baskets(df).cache()
    true = lambda s: sum(set(s) <= set(b) for b in baskets)
    asked = [list(c) for k in (1, 2, 3) for c in combinations(range(1, 14), k)][::7]
    got = itemsets.itemset_support(weighted, spark.createDataFrame([(a,) for a in asked], "itemset array<int>"), counts)
    assert {tuple(r["itemset"]): r["support"] for r in got.collect()} == {tuple(a): true(a) for a in asked}
    prefixes = spark.createDataFrame([([3, 1],), ([5],), ([1, 3],)], "prefix array<int>")
    ext = itemsets.extend_prefixes(weighted, prefixes, spark.createDataFrame([(i,) for i in range(1, 14)], "item int"), counts)
    assert {(tuple(r["prefix"]), r["item"]): r["support"] for r in ext.collect()} == {(p, i): true((*p, i)) for p in ((1, 3), (5,)) for i in range(1, 14) if i not in p}
    every = [r["item"] for r in counts.collect()]
    expected = {c: true(c) for k in (2, 3, 4) for c in combinations(range(1, 13), k) if true(c)}
    for strategy in ("explode", "bitmap"):
        assert {tuple(r["itemset"]): r["support"] for r in itemsets.enumerate_itemsets(weighted, every, 4, strategy).collect()} == expected


def test_exact_supports_match_fpgrowth(spark, t10):
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=1e-9).fit(t10)
    ours = jobs.exact_rules_job(t10, 4, 6)["supports"]
    assert {tuple(r["itemset"]): r["support"] for r in ours.collect()} == {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect()}


def test_last_draws_are_those_of_branch_after_branch(spark):
    rng = random.Random(5)
    rows = [(run, [b], f"{i}", [i], rng.random(), 2) for run in range(20) for b in range(1, 5) for i in rng.sample(range(6), 4)]
    df = spark.createDataFrame(rows, "run_id int, path array<int>, item string, itemset array<int>, v double, bf int")
    expected = set()
    for run in range(20):
        taken: set[int] = set()
        for b in range(1, 5):
            own = sorted((v, i) for r, p, _, (i,), v, _ in rows if r == run and p == [b] and i not in taken)[:2]
            taken |= {i for _, i in own}
            expected |= {(run, b, i) for _, i in own}
    assert {(r["run_id"], r["path"][0], r["itemset"][0]) for r in jobs._last_draws(df, 2)[0].collect()} == expected


def test_private_job_does_not_depend_on_partitions(spark, t10):
    runs = [jobs.Run(0, 1.0, 0.1, 0.5, 3, 5, 2), jobs.Run(1, 0.5, 0.2, 0.3, 2, 4, 3, seed=7)]
    for options in ({}, {"quality": "delta"}, {"quality": "d"}, {"first_item": "em"}, {"forced_last": True}):
        a = jobs.private_rules_job(t10, runs, **options)
        b = jobs.private_rules_job(t10.repartition(7), runs, **options)
        rows = sorted(map(str, a["rules"].collect()))
        assert rows == sorted(map(str, b["rules"].collect()))
        assert a["leaves"].groupBy("run_id").count().where("run_id = 1 AND count > 9").count() == 0
        assert a["rules"].where("sup_ab > sup_a OR conf < 0 OR conf > 1").count() == 0


def test_stored_stats(spark, t10, tmp_path):
    stats = jobs.exact_rules_job(t10, 3, 3)["stats"]
    tables.save_itemset_stats(stats, str(tmp_path / "s"), 3, 3)
    assert tables.load_itemset_stats(spark, str(tmp_path / "s"), 3, 3).count() == 4
    assert tables.load_itemset_stats(spark, "-", 3, 3).count() == 0
    with pytest.raises(ValueError, match="lmax=2"):
        tables.load_itemset_stats(spark, str(tmp_path / "s"), 2, 3)


LOG = """Called with: argc=10
./dph inputs/data/datasets/mushroom.dat recall.dat_3_50 0.5 0.01 0.5 3 50 2 42
...
Total leaves 8
Rules saved: 40, minconf: 0.10, maxconf: 1.00
Total time:  0.50
Final histogram:
\t0.50\t         4\t0.10\t          20\t0.50
\t0.00\t         4\t0.10\t          40\t1.00
Confthr:           0.30           0.50           0.70
Private:             30             20             12
Real   :            300            200            120
Recall :           0.10           0.10           0.10
"""


def test_run_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text("\n".join(LOG.splitlines()[:6]))
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper/c.log").write_text(LOG)
    a, b = text.read_run_logs(spark, str(tmp_path)).orderBy("file").drop("file").collect()
    assert tuple(a) == ("mushroom", 0.5, 0.01, 0.5, 3, 50, 2, 42, 8, 0.5, 0.0625, 40, 20, 0.5, 200, 0.1)
    assert b["leaves"] == 8
    assert b["rules"] is None
    runs = text.read_run_logs(spark, str(tmp_path)).drop("file").where("rules IS NOT NULL")
    text.write_runs(runs, str(tmp_path / "runs"))
    assert text.read_runs(spark, str(tmp_path / "runs"), sep="\t").collect() == runs.collect()


def test_histogram_lines(spark, k5, tmp_path):
    hist = rules.conf_histogram(rules.rules_from_itemsets(k5, k5))
    parsed = text.parse_histogram_lines(text.histogram_lines(hist))
    assert sorted(tuple(r) for r in parsed.select("bound", "n", "cum_n").collect()) == sorted(tuple(r) for r in hist.select("bound", "n", "cum_n").collect())
    with pytest.raises(Exception, match="not a bound"):
        text.parse_histogram_lines(lines(spark, ["\t0.55\t1\t0.1\t1\t0.1"])).collect()
    found = rules.rules_from_itemsets(k5, k5)
    text.write_rules_text(found, str(tmp_path / "rules"))
    stored = spark.read.text(str(tmp_path / "rules"))
    assert stored.where("value = '6 -> 11 | c=0.538788'").count() == 1
    assert rules.distinct_rule_digits(stored).agg(F.sum("n")).first()[0] == 180


def test_grids_and_series(spark):
    grid = experiments.param_grid(spark, limit=4, shelves=[1, 2, 4], bins=[1, 2, 3])
    assert {(r["shelves"], r["bins"]) for r in grid.collect()} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (4, 1)}
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, x int")
    assert {r["k"] for r in experiments.complete_series(df, ["k"], 2).collect()} == {"a"}


@pytest.mark.parametrize("mode", ["sigma", "delta"])
def test_chained_modes(k5, mode):
    assert [(list(r["itemset"]), r["score"]) for r in jobs.chain_job(k5, 5, 5, f"{mode}-d").orderBy("step").collect()] == CHAINS[mode]
    with pytest.raises(ValueError):
        jobs.chain_job(k5, 5, 5, "d-sigma")
    with pytest.raises(ValueError):
        jobs.best_extension(k5, [6], 2, "other")


def test_reductions_are_the_reference(spark):
    baskets = [{1, 2, 3}, {1, 2}, {2, 3, 4}, {1, 2, 3, 4}, {3}, {1, 3}, {2, 4}, {1, 2, 3, 6}, {6, 2}, {1, 4, 6}, {4, 6}, {4}]

    def sup(*x):
        return sum(set(x) <= b for b in baskets)

    def brute(xs, quality, fun, asymmetric):
        xs, ep, ab = list(xs), len(xs) - 1, sup(*xs)
        if quality == "d":
            gaps = [ab / 0.4 - sup(x) for x in xs]
            return fun(-abs(min(g, 0) if asymmetric else g) for g in gaps)
        found = [ab - sup(*xs[:ep])]
        for i in range(len(xs)):
            xs[ep], xs[i] = xs[i], xs[ep]
            found += [ab - sup(*xs[:j]) for j in range(1, ep)]
            xs[ep], xs[i] = xs[i], xs[ep]
        return fun(found)

    weighted = spark.createDataFrame([(sorted(b), 1) for b in baskets], "items array<int>, w long")
    counts = spark.createDataFrame([(x, sup(x)) for x in (1, 2, 3, 4, 6)], "item int, cnt long")
    sets = [(4, 1, 2), (1, 2, 4), (6, 3, 1), (2, 3, 1), (3, 6, 2), (4, 1, 3, 2), (2, 6, 1, 3), (6, 4, 2, 1), (2, 1), (4, 6)]
    for quality, fun, asymmetric in [("delta", max, False), ("delta", min, False), ("d", max, False), ("d", min, True)]:
        for width in (1, 2, 3):
            own = [x for x in sets if len(x) == width + 1]
            rows = [(0, [k], list(x[:-1]), x[-1], sup(*x), sup(*x[:-1]), sup(x[-1]), [sup(y) for y in x[:-1]], 0.4) for k, x in enumerate(own)]
            c = spark.createDataFrame(rows, "run_id int, path array<int>, prefix array<int>, item int, support long, sup_prefix long, cnt long, cnts array<long>, c0 double")
            got = {r["path"][0]: r["q"] for r in jobs.candidate_quality(c, weighted, counts, width, quality, reduce=fun.__name__, asymmetric=asymmetric).collect()}
            assert got == pytest.approx({k: brute(x, quality, fun, asymmetric) for k, x in enumerate(own)})
    table = spark.createDataFrame([(k, sorted(b)) for k, b in enumerate(baskets)], "tid long, items array<int>")
    leaves = jobs.private_rules_job(table, [jobs.Run(0, 2.0, 0.1, 0.4, 4, 5, 1)], "delta", reduce="min", asymmetric=True, forced_last=True)["leaves"].collect()
    assert len(leaves) == 1 and len(leaves[0]["itemset"]) == 4
