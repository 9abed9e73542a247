"""The forms that keep wide baskets, many sets, hot items and long sweeps within bounds, against plain ones."""

import random
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.functions.scalars import hash_uniform
from marketloom.operators import experiments, items, itemsets, nested, sampling, vertical
from marketloom.plans import jobs, stored
from marketloom.sources import tables, text


def baskets_of(spark, sets):
    return spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "tid long, items array<int>")


def weighted_of(spark, sets, weights=None):
    return spark.createDataFrame([(sorted(s), w) for s, w in zip(sets, weights or [1] * len(sets), strict=True)], "items array<int>, w long")


def random_sets(n, items_, most, seed):
    rng = random.Random(seed)
    return [set(rng.sample(range(1, items_ + 1), rng.randint(1, most))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("block", "classes"), [(1, 1), (7, 3), (64, 8), (1 << 15, 100)])
def test_vertical_counts_are_brute_force(spark, block, classes):
    sets = random_sets(60, 20, 12, 1)
    weights = [random.Random(2).choice([1, 2, 5, 1000]) + k % 3 for k in range(60)]
    kept = [i for i in range(1, 25) if i != 7]  # one item of the baskets isn't wanted, some wanted are in none
    expected = Counter()
    for s, w in zip(sets, weights, strict=True):
        for k in (2, 3, 4):
            for c in combinations(sorted(s - {7}), k):
                expected[c] += w
    found = vertical.enumerate_vertical(weighted_of(spark, sets, weights).repartition(3), kept, 4, block, classes)
    assert {tuple(r["itemset"]): r["support"] for r in found.collect()} == expected


def test_vertical_at_the_edges(spark):
    none = weighted_of(spark, [{1, 2}]).where("false")
    assert vertical.enumerate_vertical(none, [1, 2, 3], 3).collect() == []
    assert vertical.enumerate_vertical(weighted_of(spark, [{1, 2}]), [1], 3).collect() == []
    assert vertical.enumerate_vertical(weighted_of(spark, [{1}, {2}, set()]), [1, 2], 2).collect() == []
    wide = [set(range(1, 121))] * 3  # one basket with 280,840 sets of three
    found = vertical.enumerate_vertical(weighted_of(spark, wide[:1], [3]), list(range(1, 121)), 3)
    assert found.agg(F.count("*"), F.min("support"), F.max("support")).first() == (120 * 119 // 2 + 120 * 119 * 118 // 6, 3, 3)
    assert found.dtypes == itemsets.enumerate_itemsets(weighted_of(spark, wide), [1, 2], 2, "explode").dtypes


def test_classes_have_about_as_many_sets():
    for n, lmax, classes in ((200, 3, 8), (1000, 2, 8), (64, 5, 16), (2, 2, 4)):
        starts = vertical.class_starts(n, lmax, classes)
        assert starts[0] == 0 and starts == sorted(set(starts))
        assert len(starts) >= min(classes, n) // 2


def test_auto_takes_bitmaps_for_wide_baskets_of_many_items(spark):
    sets = random_sets(12, 70, 30, 5)
    a = itemsets.enumerate_itemsets(weighted_of(spark, sets), list(range(1, 71)), 2)
    assert "FlatMapGroupsInArrow" in plan(a)
    b = itemsets.enumerate_itemsets(weighted_of(spark, sets), list(range(1, 71)), 2, "explode")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_nodes_are_the_distinct_prefixes(spark):
    for seed, parts in ((1, 1), (2, 5), (3, 40)):
        rng = random.Random(seed)
        lists = {tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 6))) for _ in range(150)}
        df = spark.createDataFrame([(list(x),) for x in lists], "items array<int>")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert items.prefix_nodes(df).first()["nodes"] == 1 + len({x[:k] for x in lists for k in range(1, len(x) + 1)})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert items.prefix_nodes(df.where("false")).first()["nodes"] == 1
    lists = pa.array([[1], [1, 2], [], [3], [3], [1, 2, 3]], pa.list_(pa.int32()))
    assert items.shared_items(lists).tolist() == [0, 1, 0, 0, 1, 0]
    assert items.shared_items(lists.slice(3)).tolist() == [0, 1, 0]


def test_nodes_move_bytes_in_proportion(spark):
    """Long baskets: no row for every prefix."""
    lists = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda x: x.cast("int")).alias("items"), "id")
    lists = lists.select(F.concat("items", F.array((F.col("id") + 401).cast("int"))).alias("items"))
    found = items.prefix_nodes(lists)
    assert found.first()["nodes"] == 1 + 400 + 40
    assert "explode" not in plan(found).lower()


def test_many_sets_walk_a_trie(spark):
    sets = random_sets(80, 12, 8, 9)
    for s in sets:
        s.add(1)  # in every basket
    weights = [1 + k % 4 for k in range(80)]
    wanted = [c for k in (1, 2, 3, 5) for c in combinations(range(1, 13), k)] + [(1, 99), (99,)]
    expected = {c: sum(w for s, w in zip(sets, weights, strict=True) if set(c) <= s) for c in wanted}
    weighted = weighted_of(spark, sets, weights)
    counts = items.item_counts(baskets_of(spark, sets))
    rows = spark.createDataFrame([(list(reversed(c)),) for c in wanted + wanted[:9]], "itemset array<int>")
    keys = rows.select(F.array_sort("itemset").alias("itemset")).distinct()
    for few, nodes in ((10_000, 10), (0, 1_000_000), (3, 400)):
        found = itemsets.contained(weighted, keys, counts, few, nodes).groupBy("itemset").agg(F.sum("w").alias("n"))
        assert {tuple(r["itemset"]): r["n"] for r in found.collect()} == {c: n for c, n in expected.items() if n}
    assert {tuple(r["itemset"]): r["support"] for r in itemsets.itemset_support(weighted, rows, counts).collect()} == expected


def test_trie_moves_no_baskets(spark):
    sets = random_sets(20, 12, 8, 4)
    keys = spark.createDataFrame([(list(c),) for c in combinations(range(1, 13), 2)], "itemset array<int>")
    found = itemsets.contained(weighted_of(spark, sets), keys, items.item_counts(baskets_of(spark, sets)), 0)
    physical = plan(found).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_extensions_by_trie(spark, monkeypatch):
    sets = random_sets(50, 10, 6, 8)
    weighted, counts = weighted_of(spark, sets), items.item_counts(baskets_of(spark, sets))
    prefixes = spark.createDataFrame([(list(c),) for c in combinations(range(1, 11), 2)], "prefix array<int>")
    few = sorted(map(str, itemsets.extension_supports(weighted, prefixes, counts).collect()))
    monkeypatch.setattr(itemsets, "SENT", 0)
    assert sorted(map(str, itemsets.extension_supports(weighted, prefixes, counts).collect())) == few


@pytest.mark.parametrize("filters", [1_000_000, 0])
def test_unseen_drops_nothing_wrongly(spark, monkeypatch, filters):
    monkeypatch.setattr(itemsets, "FILTERS", filters)
    monkeypatch.setattr(itemsets, "WORDS", 4)  # so full that nearly everything may have been seen
    rng = random.Random(6)
    every = [(r, list(c)) for r in range(3) for c in combinations(range(1, 15), 2)]
    seen = rng.sample(every, 120)
    candidates = spark.createDataFrame(every + every[:5], "run_id int, itemset array<int>")
    known = spark.createDataFrame(seen + seen[:7], "run_id int, itemset array<int>")
    found = itemsets.unseen(candidates, known, "run_id")
    left = Counter((r, tuple(c)) for r, c in every + every[:5] if (r, c) not in seen)
    assert Counter((r["run_id"], tuple(r["itemset"])) for r in found.collect()) == left
    assert ("bit_or" in plan(found)) == bool(filters)
    assert itemsets.unseen(candidates, known.where("false"), "run_id").count() == len(every) + 5
    assert itemsets.unseen(candidates.where("false"), known, "run_id").count() == 0
    by_set = itemsets.unseen(candidates, known.drop("run_id"))
    assert {tuple(r["itemset"]) for r in by_set.collect()} == {tuple(c) for _, c in every} - {tuple(c) for _, c in seen}


def test_reservoir_is_cut_before_it_moves(spark, monkeypatch):
    """A group with all rows: every task sends as many as are drawn, and no more."""
    df = spark.range(0, 200_000, 1, 16).select((F.col("id") % 1).alias("g"), (F.col("id") % 50).alias("k"), "id", F.rand(3).alias("w"), F.lit(7).alias("n"))
    u = hash_uniform(1, F.col("id"))
    drawn = sampling.weighted_sample(df, ["g"], F.col("n"), "w", u, ["id"], most=7)
    physical = plan(drawn).split("== Physical Plan ==")[1]
    assert "WindowGroupLimit [g" in physical and physical.index("Final") < physical.index("Exchange") < physical.index("Partial")
    plain = df.withColumn("v", -F.log(u) / F.col("w")).orderBy("v", "id").limit(7)
    assert [r["id"] for r in drawn.orderBy("draw").collect()] == [r["id"] for r in plain.collect()]
    monkeypatch.setattr(sampling, "LIMITED", 3)
    salted = sampling.weighted_sample(df, ["g"], F.col("n"), "w", u, ["id"], most=7)
    assert salted.columns == drawn.columns
    assert [r["id"] for r in salted.orderBy("draw").collect()] == [r["id"] for r in plain.collect()]
    unknown = sampling.weighted_sample(df, ["k"], F.col("n") - 2, "w", u, ["id"])
    assert unknown.groupBy("k").count().where("count <> 5").count() == 0


def test_nested_totals_are_separate_jobs(spark):
    baskets = baskets_of(spark, random_sets(90, 9, 6, 12))
    totals = {(r["lmax"], r["ni"]): r for r in jobs.nested_job(baskets, 4, 9).collect()}
    assert set(totals) == set(product((2, 3, 4), range(1, 10)))
    for lmax, ni in ((2, 1), (2, 5), (3, 4), (3, 9), (4, 7), (4, 9)):
        job = jobs.exact_rules_job(baskets, lmax, ni)
        stats = job["stats"].agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n30", "n50", "n70"))).first()
        own = totals[lmax, ni]
        assert (own["n_sets"], own["n30"], own["n50"], own["n70"]) == tuple(stats)
        assert own["n_rules"] == job["rules"].count()


def test_sweep_takes_its_real_rules_from_one_enumeration(spark):
    baskets = baskets_of(spark, random_sets(90, 9, 6, 13))
    runs = [jobs.Run(k, 1.0, 0.1, 0.5, 3, ni, 2) for k, ni in enumerate((3, 6, 9))]
    one = jobs.sweep(baskets, "x", runs, jobs.nested_job(baskets, 3, 9))
    each = jobs.sweep(baskets, "x", runs, {(3, r.ni): jobs.exact_rules_job(baskets, 3, r.ni)["stats"] for r in runs})
    assert sorted(map(str, one.collect())) == sorted(map(str, each.collect()))
    totals = jobs.nested_job(baskets, 3, 9)
    found = nested.nested_recall(jobs.private_rules_job(baskets, runs)["stats"], spark.createDataFrame([(r.run_id, r.lmax, r.ni) for r in runs], "run_id int, lmax int, ni int"), totals)
    at = {(r["run_id"], r["threshold"]): r for r in found.collect()}
    for r in one.collect():
        assert at[r["run_id"], 0.5]["real"] == r["realrls"]
        assert len(at) == 9


def test_stored_counts_are_replaced(spark, tmp_path):
    path = str(tmp_path / "s")
    stats = jobs.exact_rules_job(baskets_of(spark, random_sets(40, 5, 4, 3)), 3, 5)["stats"]
    none = stats.where("false")
    load = lambda lmax, ni: sorted(map(str, tables.load_itemset_stats(spark, path, lmax, ni).collect()))
    every = sorted(map(str, stats.collect()))
    tables.save_itemset_stats(none, path, 2, 5)
    assert load(2, 5) == []
    for _ in range(2):
        tables.save_itemset_stats(stats, path, 3, 5)
        assert load(3, 5) == every
    tables.save_itemset_stats(stats.where("support > 10"), path, 3, 6)
    tables.save_itemset_stats(none, path, 3, 5)
    assert load(3, 5) == [] and len(load(3, 6)) == stats.where("support > 10").count()
    tables.save_itemset_stats(stats, path, 2, 5)
    assert load(2, 5) == every
    assert {(r["lmax"], r["ni"]): r["n_sets"] for r in tables.saved_itemset_stats(spark, path).collect()} == {(2, 5): len(every), (3, 5): 0, (3, 6): len(load(3, 6))}
    # what was replaced is gone
    assert spark.read.parquet(f"{path}/stats").count() == len(every) + len(load(3, 6))
    with pytest.raises(ValueError, match="lmax=4"):
        load(4, 5)


def whole_log(seed, bins, counts, cut=None):
    total, running, out = sum(counts), 0, []
    for k, n in enumerate(counts):
        running += n
        out.append(f"\t{0.9 - k / 10:3.2f}\t{n:10d}\t{n / total:3.2f}\t{running:12d}\t{running / total:3.2f}")
    head = ["Called with: argc=10", f"./dph data/x.dat real 0.5 0.1 0.5 3 50 {bins} {seed}", "fp-tree: items: 5", f"Rules saved: {total}, minconf: 0.00, maxconf: 1.00", "Level histogram:", "\t0.90\t         1\t0.00\t           1\t0.00", "", "Final histogram:"]
    return "\n".join([*head, *out[:cut], "Confthr:           0.30           0.50           0.70", "Real   :            300            200            120"][: None if cut is None else len(head) + cut]) + "\n"


def test_histograms_of_log_files(spark, tmp_path):
    counts = {(1, 2): [1, 0, 2, 0, 3, 0, 0, 0, 4, 0], (2, 2): [3, 0, 0, 0, 1, 0, 0, 0, 0, 2], (1, 4): [0] * 9 + [8]}
    for (seed, bins), c in counts.items():
        (tmp_path / f"x_seed_{seed}_sh_3_bins_{bins}").write_text(whole_log(seed, bins, c))
    (tmp_path / "x_seed_3_sh_3_bins_2").write_text(whole_log(3, 2, [9] * 10, cut=9))
    (tmp_path / "x_seed_4_sh_3_bins_2").write_text("")
    (tmp_path / "x_seed_5_sh_3_bins_2").write_text(whole_log(5, 2, [9] * 10)[:-170])  # within the last lines of the histogram
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper/x_seed_9_sh_3_bins_2").write_text(whole_log(9, 2, [9] * 10))
    lines_ = text.read_log_lines(spark, str(tmp_path))
    one = [r["value"] for r in lines_.where("file LIKE '%seed_1_sh_3_bins_2'").orderBy("pos").collect()]
    assert "\n".join(one) == whole_log(1, 2, counts[1, 2])
    final = text.final_histograms(lines_).collect()
    got = defaultdict(list)
    for r in sorted(final, key=lambda r: -r["bound"]):
        got[r["file"].rsplit("/", 1)[1]].append((r["n"], r["cum_n"], r["expected"], r["rules_saved"]))
    assert {k: [x[0] for x in v] for k, v in got.items()} == {f"x_seed_{s}_sh_3_bins_{b}": c for (s, b), c in counts.items()}
    assert all([x[1] for x in v] == np.cumsum([x[0] for x in v]).tolist() and {x[2:] for x in v} == {(int(k[-1]), v[-1][1])} for k, v in got.items())
    report = jobs.report_from_logs(spark, str(tmp_path))
    at = {(r["experiment"].split("\t")[-1], r["bound"]): r for r in report["histograms"].collect()}
    assert (at["2", 0.0]["runs"], at["2", 0.0]["mean_cum"], at["2", 0.0]["of_expected"], at["2", 0.5]["mean_cum"], at["2", 0.0]["mean_saved"]) == (2, 8.0, 4.0, 5.0, 8.0)
    assert at["4", 0.9]["mean_cum"] == 0 and at["4", 0.0]["of_total"] == 1
    matrix = experiments.layer_bin_matrix(report["final"], 2)
    assert {r["bound"]: (r["2"], r["4"], r["7"]) for r in matrix.collect()}[0.5] == (5.0, 0.0, 0.0)


def test_temporary_tables_go(spark):
    df = spark.range(5)
    with stored.temporary(spark):
        gone = stored.stored(df, "gone")
        left = stored.kept(gone.where("id > 2"), "left")
        assert gone.count() == 5
    assert left.count() == 2
    with pytest.raises(Exception, match=r"(?i)does not exist|not found|no such"):
        gone.count()


def test_class_draws_are_distributed_as_the_grid(spark):
    """The smallest keys of 12 items of one score, over many seeds: by class and by a key for each item."""
    zeros, seeds, k = list(range(3, 15)), 6000, 3
    prefixes = spark.range(seeds).select(F.col("id").cast("int").alias("seed"), F.array(F.lit(1), F.lit(2)).alias("prefix"), F.array(*map(F.lit, zeros)).alias("zeros"))
    by_class = sampling.class_draws(prefixes, 2, k)
    each = prefixes.select("seed", F.explode("zeros").alias("item")).withColumn("v", F.log(-F.log(hash_uniform(F.col("seed"), F.lit("grid"), F.col("item")))))
    by_grid = sampling.smallest(each, ["seed"], k, ["v", "item"], name="slot")
    for drawn in (by_class, by_grid):
        rows = drawn.select("seed", "slot", "item", "v").orderBy("seed", "slot").collect()
        assert len(rows) == seeds * k
        items_ = np.array([r["item"] for r in rows]).reshape(seeds, k)
        gaps = np.diff(np.exp([r["v"] for r in rows]).reshape(seeds, k), axis=1, prepend=0)
        assert all(len(set(x)) == k for x in items_.tolist()) and (gaps > 0).all()
        for j in range(k):
            # gaps are exponentials over what is left; items are uniform
            assert gaps[:, j].mean() * (12 - j) == pytest.approx(1, abs=0.06)
            assert gaps[:, j].std() * (12 - j) == pytest.approx(1, abs=0.1)
            often = np.bincount(items_[:, j] - 3, minlength=12)
            assert ((often - seeds / 12) ** 2 / (seeds / 12)).sum() < 31.3  # of 11 degrees of freedom, one in a thousand
        pairs = Counter(map(tuple, np.sort(items_[:, :2], axis=1).tolist()))
        assert sum((pairs[c] - seeds / 66) ** 2 / (seeds / 66) for c in combinations(zeros, 2)) < 108
    none = prefixes.withColumn("zeros", F.array().cast("array<int>"))
    assert sampling.class_draws(none, 2, k).count() == 0
    one = prefixes.limit(5).withColumn("zeros", F.array(F.lit(9)))
    assert {(r["slot"], r["item"]) for r in sampling.class_draws(one, 2, k).collect()} == {(1, 9)}


def test_class_draws_end_where_no_set_is_left(spark):
    """Branches that take each other's sets: four draws each among five items of which no two are in a basket."""
    baskets = baskets_of(spark, [{k} for k in (1, 2, 3, 4, 5)] * 3)
    runs = [jobs.Run(k, 1.0, 0.5, 0.5, 3, 5, 4, seed=k) for k in range(3)]
    for zeros in ("grid", "class"):
        leaves = jobs.private_rules_job(baskets, runs, zeros=zeros)["leaves"].collect()
        by_run = defaultdict(list)
        for r in leaves:
            by_run[r["run_id"]].append(tuple(r["itemset"]))
        assert all(len(x) == len(set(x)) and all(len(set(c)) == 3 for c in x) for x in by_run.values())
        assert all(len(x) == 10 for x in by_run.values()), zeros  # every set of three
    with pytest.raises(ValueError, match="sigma"):
        jobs.private_rules_job(baskets, runs, "delta", zeros="class")
