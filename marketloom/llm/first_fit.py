"""First-fit decreasing in randomised groups, by a tournament tree of the room left in each sequence.

What fills whole sequences is cut off a document first. What remains of it is dealt at random to a group, and each group packs its own: from
the longest to the shortest, each goes into the first sequence that has room, found by walking down a tree whose nodes hold the most room of the
sequences below them. Then the emptiest sequences of the group are taken apart again and their documents cut to fill the gaps of the others
exactly; the rest, less than a sequence, is cut to lengths that are powers of two, which need no padding. So only few documents are cut,
and nothing is padded.

How it scales: texts are encoded where they are read; only what doesn't fill a sequence is moved, as ids of two bytes each, to groups of about
``PER_GROUP`` documents however many there are. A group is dealt by the number of a row, so that no key makes one large.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text_arrays import mix, pieces
from .word_ids import WordEnds

CAPACITY, END_ID = 2048, 1
PER_GROUP = 8_192
#: Sequence ids of pieces that fill a sequence of their own begin here.
WHOLE = 1 << 62


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece that fills a sequence, and for what remains of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, deal, ids.

    Pieces that fill a sequence have a ``sequence_id``; the others have their ``ids`` and a random number ``deal``. A null text is an
    empty one, whose only id is ``end_id``. Null ids and repeated rows are kept and cut like any others.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = WordEnds.of(vocabulary), TaskContext.get().partitionId() << 36
        end = np.array([end_id], coder.kind).tobytes()
        for batch in pieces(it, 1, 1 << 20, "word_ids"):
            source, rows = [], []
            for k, ids in enumerate(coder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // coder.kind.itemsize
                wide = np.frombuffer(ids, coder.kind).astype("<u4")
                for at in range(0, n, capacity):
                    length, number = min(capacity, n - at), number + 1
                    whole = length == capacity
                    rows.append((at, length, zlib.crc32(wide[at : at + length].tobytes()), n, WHOLE + number if whole else None, None if whole else number, None if whole else wide[at : at + length].astype(coder.kind).tobytes()))
                    source.append(k)
            start, length, crc, tokens, sequence, deal, ids = zip(*rows, strict=True)
            dealt = [None if d is None else int(x) for d, x in zip(deal, mix(np.array([d or 0 for d in deal], np.uint64)).view(np.int64), strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc, tokens, sequence, dealt)] + [pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "deal", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, deal long, ids binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of every size, and what each bin holds. A size goes into the first bin with room for it."""
    # no two bins are half empty, so there are fewer than this
    most = min(len(sizes), 2 * int(sizes.sum()) // capacity + 1)
    leaves = 1 << max(0, most - 1).bit_length()
    room = [capacity] * (2 * leaves)  # of node k: the most room in its bins; its halves are 2k and 2k + 1
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            node += room[node] < size
        bins[i], places[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node >>= 1
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left > right else right
            if room[node] == most:
                break
            room[node] = most
    fill = capacity - np.array(room[leaves:], np.int64)
    return bins, places, fill[fill > 0]


def is_power_of_two(n: np.ndarray) -> np.ndarray:
    return (n & (n - 1)) == 0


def without_gaps(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, bin, place in it) of the pieces of all items: bins hold ``capacity`` or a power of two each.

    Bins that first-fit decreasing has left with gaps take from the emptiest of them; every other item stays whole.
    """
    bins, places, fill = first_fit_decreasing(sizes, capacity)
    gaps = np.flatnonzero((fill < capacity) & ~is_power_of_two(fill))
    gaps = gaps[np.argsort(-fill[gaps], kind="stable")]
    # the most bins that the ones after them can fill
    need = np.concatenate([[0], np.cumsum(capacity - fill[gaps])])
    have = fill[gaps].sum() - np.concatenate([[0], np.cumsum(fill[gaps])])
    kept = int(np.flatnonzero(have >= need)[-1])
    spare = int(have[kept] - need[kept])
    apart = np.zeros(len(fill), bool)
    apart[gaps[kept:]] = True
    stay = np.flatnonzero(~apart[bins])
    out = [(i, 0, int(sizes[i]), int(bins[i]), int(places[i])) for i in stay.tolist()]
    # holes: the gaps, then bins of powers of two that make up the rest
    holes = [(int(b), int(fill[b]), int(capacity - fill[b])) for b in gaps[:kept]]
    ends = [1 << k for k in range(spare.bit_length() - 1, -1, -1) if spare >> k & 1]
    holes += [(len(fill) + k, 0, n) for k, n in enumerate(ends)]
    at = 0
    for i in np.flatnonzero(apart[bins])[np.argsort(-sizes[apart[bins]], kind="stable")].tolist():
        used = 0
        while used < sizes[i]:
            b, place, left = holes[at]
            n = min(left, int(sizes[i]) - used)
            out.append((i, used, n, b, place))
            used += n
            if n == left:
                at += 1
            else:
                holes[at] = (b, place + n, left - n)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP) -> DataFrame:
    """Every piece with its sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; from what ``cut_documents`` gives.

    Every sequence holds ``capacity`` tokens or a power of two. Repeated rows are all placed; equal lengths are placed in the order of their
    ids' checksums and document ids. Without documents there are no rows.
    """
    cut = written(cut, "cut")
    whole = cut.where("sequence_id IS NOT NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    rest = cut.where("sequence_id IS NULL").drop("sequence_id")
    groups = max(1, -(-rest.count() // per_group))

    def place(key: tuple, table: pa.Table) -> pa.Table:
        # arrival differs between attempts of a task; this order doesn't
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes, start, crc, ids = table["length"].to_numpy(), table["start"].to_numpy(), table["ids_crc32"].to_numpy(), table["ids"]
        item, begin, length, bin_, offset = (np.array(x, np.int64) for x in zip(*without_gaps(sizes, capacity), strict=True))
        sums = crc[item].copy()
        for k in np.flatnonzero(length < sizes[item]).tolist():
            own = ids[int(item[k])].as_py()
            kind = np.dtype(f"<u{len(own) // int(sizes[item[k]])}")
            sums[k] = zlib.crc32(np.frombuffer(own, kind)[begin[k] : begin[k] + length[k]].astype("<u4").tobytes())
        group = int(key[0].as_py()) << 32
        columns = {"start": start[item] + begin, "length": length, "ids_crc32": sums, "doc_tokens": table["doc_tokens"].to_numpy()[item], "sequence_id": group + bin_, "offset": offset}
        return pa.table({"doc_id": table["doc_id"].combine_chunks().take(pa.array(item)), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields)
    placed = rest.withColumn("group", F.pmod("deal", F.lit(groups))).groupBy("group").applyInArrow(place, fields)
    return whole.unionByName(placed)
