"""Best-fit packing of tokenized documents into sequences, with certified lower bounds.

Only documents longer than a sequence are cut; the remainder comes first, so that every other piece fills a sequence of its
own. All pieces are dealt to partitions and each packs its own by best-fit decreasing. Dual-feasible functions give a lower
bound on the sequences that a partition's pieces need; where a partition reaches it, its packing is certified as optimal and stands. The others
keep their full and nearly full sequences and exchange the documents of the rest: these are dealt anew, packed again, and so on while the
count falls.

How it scales: texts are tokenized where they are read and never moved; what is exchanged is five numbers per piece. A partition
holds about ``PER_PARTITION`` pieces however many there are. The driver sees two counts per round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written
from .text_arrays import pieces
from .token_ids import REMEMBERED, WordCoder

CAPACITY, END_ID = 1024, 2
PER_PARTITION = 100_000
#: Rounds of exchange at most. Each packs what the one before has left in unfilled sequences; it ends earlier where that saves none.
ROUNDS = 4
#: A sequence is nearly full if no more than one of so many parts is free.
NEARLY = 64


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A worker remembers the ids of so many words.

    A null text is an empty one, whose only id is ``end_id``. Null ids and repeated rows are kept and cut like any others. Texts of any
    length are encoded whole. An empty table gives no rows. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.of(vocabulary, remembered)
        for batch in pieces(it, 1, 1 << 20, "coders"):
            source, rows = [], []
            for k, ids in enumerate(coder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                at = 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    rows.append((0 if not at else rows[-1][0] + 1, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    source.append(k)
                    at += length
            columns = [batch.column(0).take(pa.array(source, pa.int64()))] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and place in it of every size, and the space left in each bin."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit s: some bin has s left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = levels >> size
        if above:
            s = size + (above & -above).bit_length() - 1
            b = open_[s].pop()
            if not open_[s]:
                levels ^= 1 << s
        else:
            s, b = capacity, len(left)
            left.append(capacity)
        bins[i], places[i] = b, capacity - s
        left[b] = s - size
        if s > size:
            open_[s - size].append(b)
            levels |= 1 << (s - size)
    return bins, places, left


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions. ``counts[s]`` pieces have size s."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):  # f(x) = capacity beyond capacity - k, 0 below k
        best = max(best, -(-int((counts * np.where(x > capacity - k, capacity, np.where(x >= k, x, 0))).sum()) // capacity))
    for p in range(1, 32):  # f(x) = floor((p + 1) x / capacity) / p, and x / capacity where (p + 1) x / capacity is whole
        whole = (p + 1) * x % capacity == 0
        best = max(best, -(-int((counts * np.where(whole, p * x, (p + 1) * x // capacity * capacity)).sum()) // (p * capacity)))
    return best


def _packed(dealt: DataFrame, round_: int, capacity: int) -> DataFrame:
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes = table["length"].to_numpy()
        bins, places, left = best_fit_decreasing(sizes, capacity)
        certified = len(left) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        spare = (np.array(left)[bins] > capacity // NEARLY) & (not certified)
        name = (round_ << 56) + (TaskContext.get().partitionId() << 32)
        columns = {"sequence_id": pa.array(bins + name), "offset": pa.array(places), "spare": pa.array(spare)}
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for k, v in columns.items():
            out = out.append_column(k, v)
        yield from out.to_batches(max_chunksize=10_000)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(pack, f"{fields}, sequence_id long, offset long, spare boolean")


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces of 1 to ``capacity`` tokens: adds sequence_id and offset to doc_id, piece, start, length, ids_crc32.

    Repeated pieces are all placed; equal sizes are placed in the order in which they arrive. Without pieces there are no rows. Other
    columns are dropped. How far the result is from the bound that no packing can beat says ``certificate``.
    """
    todo = written(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    done, before = [], None
    for r in range(rounds):
        # by numbers of rows only, so that no key makes a partition large
        dealt = todo.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(max(1, -(-todo.count() // per_partition)))
        placed = written(_packed(dealt, r, capacity), "packed")
        if not r:
            discard(todo)
        if before is not None and placed.select("sequence_id").distinct().count() >= before:
            break  # the packing of the round before is no worse
        if before is not None:
            done[-1] = done[-1].where("NOT spare")
        done.append(placed)
        todo = placed.where("spare")
        before = todo.select("sequence_id").distinct().count()
        if before <= 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("spare")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences used, and the number that no packing of these pieces can be below."""
    rows = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each size, capacity at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "lower_bound": lower_bound(counts, capacity)}
