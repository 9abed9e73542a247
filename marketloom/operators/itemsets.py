"""Itemsets: enumeration, supports of given sets, extensions of prefixes, and set predicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import canonical, subsets
from marketloom.operators.vertical import enumerate_vertical

#: With more subsets per distinct basket than this on average, counting by bitmaps is less work than emitting them.
DENSE = 400
#: Sets that a task holds with their counts before it passes them on, and sets or items that are sent to all tasks at most.
HELD, SENT = 1 << 20, 10_000
#: Prefixes of a trie of sets that is sent to all tasks at most: up to 50 MB.
NODES = 500_000
#: Words of a filter of seen sets for each key, and rows of all filters that are sent to all tasks at most.
WORDS, FILTERS = 1 << 16, 1_000_000


def enumerate_itemsets(weighted: DataFrame, items: list[int], lmax: int, strategy: str = "auto") -> DataFrame:
    """(itemset, support) of every set of 2 to ``lmax`` of the items that some basket holds.

    ``explode`` emits each basket's subsets and adds them up; ``bitmap`` counts all sets of the items per task, for dense baskets of few items;
    ``vertical`` counts by bitmaps of blocks of baskets, a task for each class of sets; ``auto`` decides by the number of subsets that the baskets
    would emit.
    """
    if strategy == "auto":
        size = F.size("items")
        emitted = sum((F.when(size >= k, F.factorial(size.cast("int")) / F.factorial(F.lit(k)) / F.factorial(F.greatest(size - k, F.lit(0)))).otherwise(0.0) for k in range(2, lmax + 1)), F.lit(0.0))
        mean = weighted.where(size <= 20).agg(F.avg(emitted)).first()[0] or 0.0
        wide = weighted.where(size > 20).limit(1).count()
        strategy = ("bitmap" if len(items) <= 63 else "vertical") if mean > DENSE or wide else "explode"
    if strategy == "vertical":
        return enumerate_vertical(weighted, items, lmax)
    return _by_bitmap(weighted, items, lmax) if strategy == "bitmap" else _by_explode(weighted, lmax)


def _by_explode(weighted: DataFrame, lmax: int) -> DataFrame:
    """Level by level within the row: each set with the items that may follow it, so every subset is made once."""
    level = weighted.select(F.explode(F.transform("items", lambda x, i: F.struct(F.array(x).alias("itemset"), F.expr("0").alias("z"), i.alias("i")))).alias("e"), "items", "w")
    level = level.select(F.col("e.itemset").alias("itemset"), F.slice("items", F.col("e.i") + 2, F.size("items")).alias("rest"), "w")
    found = None
    for _ in range(2, lmax + 1):
        step = level.select("itemset", "rest", "w", F.posexplode("rest").alias("i", "x"))
        level = step.select(F.concat("itemset", F.array("x")).alias("itemset"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), "w")
        found = level.select("itemset", "w") if found is None else found.unionByName(level.select("itemset", "w"))
    return found.groupBy(canonical("itemset").alias("itemset")).agg(F.sum("w").alias("support"))


def _by_bitmap(weighted: DataFrame, items: list[int], lmax: int) -> DataFrame:
    order = sorted(items)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(k) for k in total], pa.list_(pa.int32())), pa.array(list(total.values()), pa.int64())], ["itemset", "support"])

        for batch in it:
            lists, w = batch.column(0), batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            value = lists.flatten().to_numpy()
            held = np.zeros((len(order), len(lists)), bool)
            at = np.searchsorted(order, value)
            known = (at < len(order)) & (np.array(order)[np.minimum(at, len(order) - 1)] == value)
            held[at[known], row[known]] = True
            columns = [(i, held[k]) for k, i in enumerate(order) if held[k].any()]

            def grow(prefix: tuple[int, ...], rows: np.ndarray, begin: int, columns=columns, w=w) -> None:
                for k in range(begin, len(columns)):
                    item, own = columns[k]
                    both = rows & own
                    if n := int(w[both].sum()):
                        name = (*prefix, item)
                        total[name] = total.get(name, 0) + n
                        if len(name) < lmax:
                            grow(name, both, k + 1)

            for k, (item, own) in enumerate(columns):
                grow((item,), own, k + 1)
                if len(total) > HELD:
                    yield counted()
                    total.clear()
        if total:
            yield counted()

    partial = weighted.select("items", "w").mapInArrow(count, "itemset array<int>, support bigint")
    return partial.groupBy("itemset").agg(F.sum("support").alias("support"))


def itemset_support(weighted: DataFrame, itemsets: DataFrame, counts: DataFrame) -> DataFrame:
    """(itemset, support) of given sets, 0 for those in no basket."""
    sets = itemsets.select(canonical("itemset").alias("itemset")).distinct()
    found = contained(weighted, sets, counts).groupBy("itemset").agg(F.sum("w").alias("support"))
    return sets.join(found, "itemset", "left").select("itemset", F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def contained(weighted: DataFrame, sets: DataFrame, counts: DataFrame, few: int | None = None, nodes: int | None = None) -> DataFrame:
    """(items, w, itemset) of every basket and each of the distinct canonical sets that it holds.

    Up to ``few`` sets are sent to the baskets and meet those that hold their rarest item. More become a trie, which baskets walk down level
    by level; it is sent as well, in blocks of about ``nodes`` prefixes with a pass over the baskets each. So baskets never move, and an
    item that is in all of them is no hot key.
    """
    few, nodes = SENT if few is None else few, NODES if nodes is None else nodes
    each = sets.select("itemset", F.explode("itemset").alias("item")).join(counts.select("item", "cnt"), "item", "left")
    rarest = each.groupBy("itemset").agg(F.min_by("item", F.struct(F.coalesce("cnt", F.lit(0)), "item")).alias("item"))
    keyed = [r[0] for r in rarest.select("item").limit(few + 1).collect()]
    if len(keyed) <= few:
        keys = F.array(*map(F.lit, sorted(set(keyed)))).cast("array<int>")
        met = weighted.select("items", "w", F.explode(F.array_intersect("items", keys)).alias("item"))
        return met.join(F.broadcast(rarest), "item").where(contains_all(F.col("items"), F.col("itemset"))).select("items", "w", "itemset")
    longest, total = sets.agg(F.max(F.size("itemset")), F.sum(F.size("itemset"))).first()
    blocks = -(-total // nodes)
    found = None
    for k in range(blocks):
        own = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("itemset"), F.lit(blocks)) == k)
        for level in _walk(weighted, own, longest):
            found = level if found is None else found.unionByName(level)
    return found


def _walk(weighted: DataFrame, sets: DataFrame, longest: int) -> list[DataFrame]:
    """(items, w, itemset) by size of the set: baskets at the nodes of the sets' trie, each with the items that may follow."""
    at = weighted.select("items", "w", F.array().cast("array<int>").alias("prefix"), F.array_sort("items").alias("rest"))
    out = []
    for size in range(1, longest + 1):
        reach = sets.where(F.size("itemset") >= size)
        steps = reach.groupBy(F.slice("itemset", 1, size - 1).alias("prefix"), F.get("itemset", F.lit(size - 1)).alias("item")).agg(F.max(F.size("itemset") == size).alias("ends"))
        met = at.select("items", "w", "prefix", "rest", F.posexplode("rest").alias("i", "item")).join(F.broadcast(steps), ["prefix", "item"])
        at = met.select("items", "w", F.concat("prefix", F.array("item")).alias("prefix"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), "ends")
        out.append(at.where("ends").select("items", "w", F.col("prefix").alias("itemset")))
        at = at.drop("ends")
    return out


def extension_supports(weighted: DataFrame, prefixes: DataFrame, counts: DataFrame) -> DataFrame:
    """(prefix, item, support) of each canonical prefix with one more item, where some basket holds both. All prefixes in one pass."""
    sets = prefixes.select(canonical("prefix").alias("itemset")).distinct()
    inside = contained(weighted, sets, counts).withColumnRenamed("itemset", "prefix")
    return inside.select("prefix", "w", F.explode(F.array_except("items", "prefix")).alias("item")).groupBy("prefix", "item").agg(F.sum("w").alias("support"))


def extend_prefixes(weighted: DataFrame, prefixes: DataFrame, items: DataFrame, counts: DataFrame) -> DataFrame:
    """The same for every item of the list, of ``SENT`` items at most, that isn't in the prefix, with 0 where no basket holds both."""
    listed = [r[0] for r in items.select("item").limit(SENT + 1).collect()]
    if len(listed) > SENT:
        raise ValueError(f"more than {SENT} items to extend prefixes with")
    every = F.explode(F.array(*map(F.lit, listed)).cast("array<int>")).alias("item")
    grid = exclude_prefix_items(prefixes.select(canonical("prefix").alias("prefix")).distinct().select("prefix", every))
    return grid.join(extension_supports(weighted, prefixes, counts), ["prefix", "item"], "left").select("prefix", "item", F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def exclude_prefix_items(candidates: DataFrame) -> DataFrame:
    """A candidate may not repeat an item of its prefix."""
    return candidates.where(~F.array_contains("prefix", F.col("item")))


def contains_all(items: Column, itemset: Column) -> Column:
    return F.size(F.array_except(itemset, items)) == 0


def itemsets_within(itemsets: DataFrame, items: list[int]) -> DataFrame:
    """Sets of which every item is among the given ones."""
    return itemsets.where(contains_all(F.array(*map(F.lit, items)).cast("array<int>"), F.col("itemset")))


def supersets_of(itemsets: DataFrame, seed: list[int], size: int) -> DataFrame:
    """Sets of that size that contain the seed."""
    return itemsets.where((F.size("itemset") == size) & contains_all(F.col("itemset"), F.array(*map(F.lit, seed)).cast("array<int>")))


def expand_leaves(leaves: DataFrame, *keys: str) -> DataFrame:
    """Every subset of two or more items of the chosen sets, each once per key."""
    return leaves.select(*keys, F.explode(subsets(canonical("itemset"), proper=False, least=2)).alias("itemset")).distinct()


def seen_filter(seen: DataFrame, *keys: str) -> DataFrame:
    """(keys, _word, _bits): a Bloom filter of the sets per key, in words of 64 bits, four of them for each set."""
    word, mask = _place_in_filter()
    return seen.select(*keys, word.alias("_word"), mask.alias("_mask")).groupBy(*keys, "_word").agg(F.bit_or("_mask").alias("_bits"))


def _place_in_filter() -> tuple[Column, Column]:
    h = F.xxhash64("itemset")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64("itemset", F.lit(1)), F.lit(WORDS)).cast("int"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def unseen(candidates: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Candidates whose set has not been generated before.

    A filter of the seen sets, sent to the candidates while it is small, tells most of the new ones where they are; only what may have been seen
    moves to be compared exactly.
    """
    seen = seen.select(*keys, "itemset")
    known = seen_filter(seen, *keys)
    if known.limit(FILTERS + 1).count() > FILTERS:
        return candidates.join(seen.distinct(), [*keys, "itemset"], "left_anti")
    word, mask = _place_in_filter()
    marked = candidates.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(known), [*keys, "_word"], "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    new = marked.where(~maybe).select(candidates.columns)
    return new.unionByName(marked.where(maybe).select(candidates.columns).join(seen.distinct(), [*keys, "itemset"], "left_anti").select(candidates.columns))
