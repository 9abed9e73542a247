"""Items of baskets: counts, ranks, top lists, and baskets restricted to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_counts(baskets: DataFrame) -> DataFrame:
    """(item, cnt): baskets that hold the item. Partial sums are taken before the shuffle, so a hot item is a row per task."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("cnt"))


def item_counts_weighted(weighted: DataFrame) -> DataFrame:
    """The same of collapsed baskets, as supports of one-item sets (itemset, support)."""
    return weighted.select("w", F.explode("items").alias("item")).groupBy("item").agg(F.sum("w").alias("support")).select(F.array("item").alias("itemset"), "support")


def zero_filled_counts(counts: DataFrame) -> DataFrame:
    """A count for every id from 1 to the largest, 0 for those never seen, so that released counts don't tell which ids exist."""
    top = counts.agg(F.max("item")).first()[0] or 0
    ids = counts.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("item"))
    return ids.join(counts, "item", "left").select("item", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def placed(df: DataFrame, name: str, band: Column, cell: Column, inside: list[Column]) -> DataFrame:
    """Number the rows from 1, by descending band, then cell, then ``inside``: as one window over all rows would, but by cells.

    Only the numbers of rows of the cells come together in one task.
    """
    celled = df.withColumns({"_band": band, "_cell": cell})
    sizes = celled.groupBy("_band", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc("_band"), "_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_band", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = celled.withColumn("_inside", F.row_number().over(Window.partitionBy("_band", "_cell").orderBy(*inside)))
    return numbered.join(starts, ["_band", "_cell"]).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def item_cell() -> Column:
    """Stretches of items in which rows of equal count are numbered."""
    return F.floor(F.col("item") / 65_536)


def item_ranks(counts: DataFrame) -> DataFrame:
    """(item, cnt, rank) by descending count, then item."""
    return placed(counts, "rank", F.col("cnt"), item_cell(), [F.col("item")])


def top_items(counts: DataFrame, ni: int) -> DataFrame:
    """The ``ni`` items with the largest counts, ties by item."""
    return counts.orderBy(F.desc("cnt"), "item").limit(ni)


def item_list(top: DataFrame, item_col: str = "item") -> list[int]:
    """The items of a table that has been cut to a stated number of them."""
    return [r[0] for r in top.select(item_col).collect()]


def restrict_to_items(baskets: DataFrame, items: list[int]) -> DataFrame:
    """Baskets with only the given items; what is left may be empty."""
    return baskets.withColumn("items", F.array_intersect("items", F.array(*map(F.lit, items)).cast("array<int>")))


def restrict_to_table(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a table of any number of items; baskets that hold none of them stay, empty."""
    held = baskets.select("tid", F.explode("items").alias("item")).join(items.select("item"), "item", "left_semi")
    kept = held.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("kept"))
    return baskets.join(kept, "tid", "left").withColumn("items", F.coalesce("kept", F.array().cast("array<int>"))).drop("kept")


def rank_sort_baskets(baskets: DataFrame, ranks: DataFrame) -> DataFrame:
    """Items of each basket from the most to the least frequent."""
    placed = baskets.select("tid", F.explode_outer("items").alias("item")).join(ranks.select("item", "rank"), "item", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("rank", "item"))))
    return placed.groupBy("tid").agg(F.transform(ordered, lambda x: x["item"]).alias("items"))


def weighted_baskets(baskets: DataFrame) -> DataFrame:
    """Identical baskets as one row with their number ``w``; empty ones are left out."""
    return baskets.where(F.size("items") > 0).groupBy("items").agg(F.count("*").alias("w"))


def basket_profile(baskets: DataFrame, nodes: bool = True) -> DataFrame:
    """One row: t baskets, largest item id n, depth (longest basket and 1) and, if asked, nodes (distinct prefixes of the rank-ordered
    baskets and 1)."""
    basic = baskets.agg(F.count("*").alias("t"), F.max(F.array_max("items")).alias("n"), (F.coalesce(F.max(F.size("items")), F.lit(0)) + 1).alias("depth"))
    if not nodes:
        return basic
    ordered = weighted_baskets(rank_sort_baskets(baskets, item_ranks(item_counts(baskets)))).select("items")
    return basic.join(F.broadcast(prefix_nodes(ordered)))  # a row on either side


def prefix_nodes(lists: DataFrame) -> DataFrame:
    """One row, ``nodes``: the distinct prefixes of the lists ``items``, the empty one included.

    Among sorted lists each has as many new prefixes as it is longer than what it shares with the one before. The lists are dealt by range, each
    part counts its own, and only its first and last list meet those of its neighbours.
    """
    lists = lists.where(F.size("items") > 0)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        new = 0
        for batch in it:
            if not batch.num_rows:
                continue
            items = batch.column(0)
            new += int(np.diff(items.offsets.to_numpy()).sum()) - int(shared_items(items).sum())
            begin = items[0].as_py()
            if first is None:
                first = begin
            else:
                new -= next((k for k, (a, b) in enumerate(zip(last, begin, strict=False)) if a != b), min(len(last), len(begin)))
            last = items[len(items) - 1].as_py()
        if first is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.list_(pa.int32())), pa.array([last], pa.list_(pa.int32())), pa.array([new])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "first", "last", "new"])

    parts = lists.repartitionByRange("items").sortWithinPartitions("items").mapInArrow(count, "part int, first array<int>, last array<int>, new bigint")
    # a row for each part
    before = F.coalesce(F.lag("last").over(Window.orderBy("part")), F.array().cast("array<int>"))
    differs = F.array_position(F.zip_with("before", "first", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(differs == 0, F.size("first")).otherwise(differs - 1)
    return parts.withColumn("before", before).agg((F.coalesce(F.sum(F.col("new") - shared), F.lit(0)) + 1).alias("nodes"))


def shared_items(lists: pa.ListArray) -> np.ndarray:
    """How many items each list begins with like the one before it; 0 for the first."""
    offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    length = np.diff(offsets)
    out = np.zeros(len(length), np.int64)
    both = np.minimum(length[1:], length[:-1])
    some = np.flatnonzero(both)
    if not len(some):
        return out
    width = both[some]
    start = np.cumsum(width) - width
    step = np.arange(width.sum()) - np.repeat(start, width)
    equal = values[np.repeat(offsets[some], width) + step] == values[np.repeat(offsets[some + 1], width) + step]
    out[some + 1] = np.minimum.reduceat(np.where(equal, np.repeat(width, width), step), start)
    return out
