"""Benchmark decontamination: prefix-filtered set join of item windows with documents, verified word by word.

A window of an item is a set of 5-word shingles (of all its words, where it has fewer than five). It is contained in a document only
if all of its shingles are, so by the prefix principle one necessary shingle is enough to find every candidate: the
rarest one, in the order of the shingles' counts over all documents. Documents join on that shingle; the positional bound
says where the window would have to begin, the length bound that it must end within the document, and the words there are then
compared with the window's. Words are compared by 64-bit hashes.

How it scales: both passes (counts, join) run over the documents where they are, without moving texts. Equal windows of any number of
items are one window; which items they are of is a table of its own, joined to the windows that were found. Distinct windows are handled
in blocks of about ``BLOCK_WINDOWS``, so that what is broadcast has a fixed bound. A benchmark of more than one block
numbers the rows of the corpus in one copy, and each block then writes its hits only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text_arrays import ALNUM, Words, pieces, windows, words

WINDOW, SHINGLE = 10, 5
#: Windows of a block: 18 numbers of 8 bytes each, 15 MB with their shingles.
BLOCK_WINDOWS = 100_000


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Per window: its item, the hashes of its words, and those of its shingles."""
    for batch in pieces(batches, 1):
        w = words(batch.column(1), ALNUM)
        for length in range(1, window + 1):
            at, _ = windows(w, length)
            at = at[(w.count[w.doc[at]] == length) | (length == window)]
            if not len(at):
                continue
            k = min(shingle, length)
            place, hash_ = windows(w, k)
            where = np.searchsorted(place, at)
            columns = [batch.column(0).take(pa.array(w.doc[at]))]
            for values, start, n in ((w.hash, at, length), (hash_, where, length - k + 1)):
                flat = values[start[:, None] + np.arange(n)].view(np.int64).ravel()
                columns.append(pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * n).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "shingles"])


def _member(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` are in the sorted ``table``, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    # a bit table first: nearly all values of a document are in no window
    bits = np.zeros(1 << 20, bool)
    bits[table & np.uint64((1 << 20) - 1)] = True
    maybe = np.flatnonzero(bits[values & np.uint64((1 << 20) - 1)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    hit = table[at] == values[maybe]
    found, place = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    found[maybe[hit]] = True
    place[maybe[hit]] = at[hit]
    return found, place


def _longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of a column, and the length of each list."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


class _Block:
    """The distinct windows of a block, ready to be joined: one necessary shingle each."""

    def __init__(self, table: pa.Table, counts: dict[int, int], shingle: int) -> None:
        self.windows = table["window"].to_numpy()
        flat, self.lengths = _longs(table["words"])
        first = np.cumsum(self.lengths) - self.lengths
        #: words by length of the window, and the row of each window there
        self.words, self.row = {}, np.zeros(len(self.lengths), np.int64)
        for n in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == n)
            self.words[int(n)] = flat[first[own][:, None] + np.arange(n)]
            self.row[own] = np.arange(len(own))
        # rarest shingle of each window: the prefix that a full overlap needs
        parts, many = _longs(table["shingles"])
        owner = np.repeat(np.arange(len(many)), many)
        distinct, code = np.unique(parts, return_inverse=True)
        often = np.array([counts.get(x, 0) for x in distinct.view(np.int64).tolist()], np.int64)[code]
        order = np.lexsort((parts, often, owner))
        best = order[np.searchsorted(owner[order], np.arange(len(many)))]
        self.offset = best - (np.cumsum(many) - many)
        key = parts[best]
        kind = np.minimum(self.lengths, shingle)
        self.by_kind = {}
        for k in sorted(set(kind.tolist())):
            own = np.flatnonzero(kind == k)
            order = own[np.argsort(key[own], kind="stable")]
            self.by_kind[k] = (*np.unique(key[order], return_index=True, return_counts=True), order)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence."""
        begins, which = [], []
        last = w.first() + w.count  # of each text
        for k, (table, first, n, order) in self.by_kind.items():
            at, hash_ = windows(w, k)
            found, place = _member(table, hash_)
            at, place = at[found], place[found]
            # a shingle may be the rarest of several windows
            many = n[place]
            at, spot = np.repeat(at, many), np.repeat(first[place], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            window = order[spot]
            begin = at - self.offset[window]
            doc = w.doc[at]
            fits = (begin >= last[doc] - w.count[doc]) & (begin + self.lengths[window] <= last[doc])
            begin, window = begin[fits], window[fits]
            for length, held in self.words.items():
                own = self.lengths[window] == length
                b, v = begin[own], window[own]
                same = np.ones(len(b), bool)
                for j in range(length):
                    same &= w.hash[b + j] == held[self.row[v], j]
                begins.append(b[same])
                which.append(v[same])
        return (np.concatenate(begins), np.concatenate(which)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _item_table(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """A row for each window of each item: item_id, window (a number), words, shingles."""
    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    cut = items.mapInArrow(lambda it: _item_windows(it, window, shingle), f"item_id {kind}, words array<long>, shingles array<long>")
    return written(cut.withColumn("window", F.xxhash64("words")), "item-windows")


def _blocks(texts: DataFrame, pairs: DataFrame, block: int, shingle: int) -> Iterator[tuple[object, int]]:
    """The windows of ``pairs`` as broadcast blocks, and how many blocks there are. One empty block where there is no window."""
    known = written(pairs.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles")), "windows")
    n = max(1, -(-known.count() // block))
    for b in range(n):
        # the number of a block comes from a hash, so that blocks need no order
        table = known.where(F.pmod(F.xxhash64("window"), F.lit(n)) == b).toArrow()
        keys = np.unique(_longs(table["shingles"])[0])
        kinds = np.unique(np.minimum(_longs(table["words"])[1], shingle)).tolist()
        yield texts.sparkSession.sparkContext.broadcast(_Block(table, _rarity(texts, keys, kinds) if kinds else {}, shingle)), n


def _joined(sent, every: bool) -> Callable:
    """Per row of (key, text): key, n_words, merged spans and distinct windows of a block; only rows with hits unless ``every``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 1):
            w = words(batch.column(1), ALNUM)
            begin, which = sent.value.hits(w)
            first = w.first()
            spans, found = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            numbers = sent.value.windows[which].tolist()
            for d, s, n, v in zip(w.doc[begin].tolist(), (begin - first[w.doc[begin]]).tolist(), sent.value.lengths[which].tolist(), numbers, strict=True):
                spans[d] += [s, s + n]
                found[d].add(v)
            kind = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(w.count.astype(np.int64)), pa.array([_merged(x) for x in spans], kind), pa.array([sorted(x) for x in found], kind)]
            out = pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "n_words", "spans", "windows"])
            yield out if every else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return run


_FOUND = "n_words long, spans array<long>, windows array<long>"


def _located(source: DataFrame, pairs: DataFrame, block: int, shingle: int) -> DataFrame:
    """Per document: doc_id, n_words, spans, windows."""
    kind = source.schema["doc_id"].dataType.simpleString()
    numbered, parts = None, []
    for sent, n in _blocks(source.select("text"), pairs, block, shingle):
        if n == 1:
            return written(source.mapInArrow(_joined(sent, True), f"doc_id {kind}, {_FOUND}"), "hits")
        if numbered is None:
            numbered = written(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
        parts.append(written(numbered.select("row", "text").mapInArrow(_joined(sent, not parts), f"row long, {_FOUND}"), "hits"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "windows")]
    by_row = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), *flat)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spans = [_merged(x) for x in batch.column(2).to_pylist()]
            yield batch.set_column(2, "spans", pa.array(spans, pa.list_(pa.int64())))

    merged = by_row.mapInArrow(merge, f"row long, {_FOUND}")
    return written(numbered.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "spans", F.array_sort("windows").alias("windows")), "hits")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, spans (start, end of the hit words, merged) and items (those with occurring windows).

    A word is a run of digits, letters and characters beyond ASCII, after lower-casing A-Z. A null text has no words, a
    null item no windows. Items with equal texts are all named; a null item_id counts as no item but its words are hit. Item ids may be of
    any type. Repeated rows are all kept. Without documents there are no rows, without items no hits. Other columns are ignored.
    """
    pairs = _item_table(benchmark, item_col, text_col, window, shingle)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _located(source, pairs, block, shingle)
    # documents with the same windows have the same items
    sets = found.where("size(windows) > 0").select("windows").distinct()
    named = sets.select("windows", F.explode("windows").alias("window")).join(pairs.select("window", "item_id").distinct(), "window")
    items = named.groupBy("windows").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    clean = found.where("size(windows) = 0").select("doc_id", "n_words", "spans", F.array().cast(items.schema["items"].dataType).alias("items"))
    return clean.unionByName(found.where("size(windows) > 0").join(items, "windows", "left").select("doc_id", "n_words", "spans", "items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs.

    Rows are judged one by one, whatever their ids; null and empty texts and repeated rows stay. Each row goes to its task and back
    once for every block of windows.
    """
    pairs = _item_table(benchmark, item_col, text_col, window, shingle)
    out, at = docs, docs.columns.index(text_col)
    for k, (sent, n) in enumerate(_blocks(docs.select(F.col(text_col).alias("text")), pairs, block, shingle)):

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(it, at):
                w = words(batch.column(at), ALNUM)
                stays = np.ones(batch.num_rows, bool)
                stays[w.doc[sent.value.hits(w)[0]]] = False
                yield batch.filter(pa.array(stays))

        out = out.mapInArrow(run, docs.schema)
        if k + 1 < n:
            out = written(out, "uncontaminated")
    return out


def _merged(spans: list[int]) -> list[int]:
    """Disjoint spans in order, from start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _rarity(texts: DataFrame, keys: np.ndarray, kinds: list[int]) -> dict[int, int]:
    """How often each shingle of the block occurs over all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in pieces(it, 0):
            w = words(batch.column(0), ALNUM)
            for k in kinds:
                found, place = _member(sent.value, windows(w, k)[1])
                total += np.bincount(place[found], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(total[some])], ["k", "n"])

    seen = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r["k"]: r["n"] for r in seen.collect()}  # a row for each shingle of the block at most


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of ``find`` per document: n_hit, n_items, items_sha256 and contaminated."""
    spans = F.col("spans")
    length = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: x - a)  # e_n - (s_n - (e_n-1 - ...)): lengths of disjoint spans add up
    return find(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        length.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def digest(items: list[int]) -> str:
    """The digest that ``decontaminate`` gives for some item ids; for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
