"""Itemsets of wide baskets and many items by vertical bitmaps: for each item a bit per basket, ANDed level by level.

Baskets are cut into blocks, each item of a block becomes one bitmap, and a set's baskets are the AND of its items' bitmaps. Sets are
divided into classes by their least item; a task counts the sets of one class in one block, for which it needs the bitmaps from that class's first item
on. Counts are added up over blocks. So neither the width of a basket nor the number of items makes the sets of one basket a burden: what moves is
a bit per basket and item for each class, and one row per set, block and class that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Baskets of a block; classes at least, and sets that a class may have at most unless it has one first item only.
BLOCK, CLASSES, SETS = 1 << 15, 8, 1 << 19
#: Bitmaps that are made at once.
TOGETHER = 512


def class_starts(n: int, lmax: int, classes: int = CLASSES) -> list[int]:
    """The first item, by place, of each class: classes have about as many sets each as the others."""
    sets = [sum(comb(n - 1 - f, k - 1) for k in range(2, lmax + 1)) for f in range(n)]
    share = min(SETS, max(1, -(-sum(sets) // classes)))
    starts, have = [0], 0
    for f, s in enumerate(sets):
        if have and have + s > share:
            starts.append(f)
            have = 0
        have += s
    return starts


def _bitmaps(it: Iterator[pa.RecordBatch], order: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """(block, place, bits) of every item of a block, and (block, -1 - p, bits) of the baskets whose weight has bit p."""
    number = TaskContext.get().partitionId() << 32

    def emit(places: list[np.ndarray], rows: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        place, row, w = np.concatenate(places), np.concatenate(rows), np.concatenate(weights)
        names, own = np.unique(place, return_inverse=True)
        for at in range(0, len(names), TOGETHER):
            inside = (own >= at) & (own < at + TOGETHER)
            held = np.zeros((min(TOGETHER, len(names) - at), len(w)), bool)
            held[own[inside] - at, row[inside]] = True
            yield _rows(number, names[at : at + TOGETHER], held)
        planes = np.arange(int(w.max()).bit_length())
        yield _rows(number, -1 - planes, (w >> planes[:, None]) & 1 == 1)
        number += 1

    places, rows, weights, n = [], [], [], 0
    for whole in it:
        at = 0
        while at < whole.num_rows:
            batch = whole.slice(at, block - n)
            lists = batch.column(0)
            value, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(order, value), len(order) - 1)
            known = order[place] == value
            places.append(place[known])
            rows.append(row[known] + n)
            weights.append(batch.column(1).to_numpy())
            at += batch.num_rows
            n += batch.num_rows
            if n == block:
                yield from emit(places, rows, weights)
                places, rows, weights, n = [], [], [], 0
    if n:
        yield from emit(places, rows, weights)


def _rows(number: int, names: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    bits = np.packbits(held, axis=1)
    columns = [pa.array(np.full(len(names), number)), pa.array(names.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "place", "bits"])


def _words(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit numbers."""
    width = -(-len(bits[0]) // 8) * 8
    return np.frombuffer(b"".join(b.ljust(width, b"\0") for b in bits), np.uint64).reshape(len(bits), -1)


def _supports(bitmaps: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The weight of the baskets of each bitmap."""
    return sum((np.bitwise_count(bitmaps & p).sum(axis=1, dtype=np.int64) << k for k, p in enumerate(planes)), np.zeros(len(bitmaps), np.int64))


def class_counts(places: np.ndarray, bitmaps: np.ndarray, planes: np.ndarray, start: int, stop: int, lmax: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sets by place, supports) of the sets of 2 to ``lmax`` items whose least place is in [start, stop); ``places`` ascend."""

    def grow(prefix: tuple[int, ...], own: np.ndarray, later: np.ndarray, bits: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        used = own != 0
        both, marks = bits[:, used] & own[used], marks[:, used]
        n = _supports(both, marks)
        some = n > 0
        later, both, n = later[some], both[some], n[some]
        if not len(later):
            return
        yield np.column_stack([*(np.full(len(later), p) for p in prefix), later]), n
        if len(prefix) + 1 < lmax:
            for k in range(len(later) - 1):
                yield from grow((*prefix, int(later[k])), both[k], later[k + 1 :], both[k + 1 :], marks)

    for k in range(int(np.searchsorted(places, start)), int(np.searchsorted(places, stop))):
        yield from grow((int(places[k]),), bitmaps[k], places[k + 1 :], bitmaps[k + 1 :], planes)


def enumerate_vertical(weighted: DataFrame, items: list[int], lmax: int, block: int = BLOCK, classes: int = CLASSES) -> DataFrame:
    """(itemset, support) of every set of 2 to ``lmax`` of the items that some basket of (items, w) holds."""
    order = np.array(sorted(items), np.int64)
    if len(order) < 2:
        return weighted.select("items", "w").where("false").toDF("itemset", "support")
    starts = class_starts(len(order), lmax, classes)
    stops = [*starts[1:], len(order)]
    blocks = weighted.select("items", F.col("w").cast("bigint").alias("w")).mapInArrow(lambda it: _bitmaps(it, order, block), "block bigint, place int, bits binary")
    # a bitmap goes to the classes whose sets it may end
    numbered = F.array(*(F.struct(F.lit(k).alias("class"), F.lit(s).alias("start")) for k, s in enumerate(starts)))
    own = F.filter(numbered, lambda c: (F.col("place") < 0) | (c["start"] <= F.col("place")))
    dealt = blocks.select(F.explode(F.transform(own, lambda c: c["class"])).alias("class"), "block", "place", "bits")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, words = table["place"].to_numpy(), _words(table["bits"].to_pylist())
        k = key[0].as_py()
        planes = words[place < 0][::-1]  # from bit 0 on
        lists, supports = [], []
        for sets, n in class_counts(place[place >= 0], words[place >= 0], planes, starts[k], stops[k], lmax):
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * sets.shape[1]), pa.array(order[sets.ravel()].astype(np.int32))))
            supports.append(n)
        return pa.table({"itemset": pa.chunked_array(lists, pa.list_(pa.int32())), "support": pa.array(np.concatenate(supports) if supports else [], pa.int64())})

    partial = dealt.groupBy("class", "block").applyInArrow(count, "itemset array<int>, support bigint")
    return partial.groupBy("itemset").agg(F.sum("support").alias("support"))
