"""Near-duplicate documents: an n-gram Jaccard join by grouped prefixes, and the components of its links.

A document's set is its distinct word shingles. Equal sets are one from the begin on. Shingles are ordered from rare to common; two sets
of similarity t or more share a shingle among the first n - ceil(t n) + 1 of either (the prefix principle). Shingles of a single set
come first and match nothing, so only the rest of a prefix is kept, and most sets have none.

Sets with the same prefix and size are one group. Groups that share a prefix shingle meet in that shingle's list; lists of the same groups are
one list. Pairs of groups are filtered by the length and positional bounds and by the part of their prefixes that they share. Only then are
groups expanded to their members, which are verified by their whole sets.

Only components are wanted, so not all pairs are: each list of groups is first compared with one member, and only while its members are in
different components with ``PIVOTS``, ``PIVOTS`` squared ... more, until a list has been compared with all of its own.

How it scales: texts are read where they are and never moved, but for the documents that are candidates. The count of each shingle needs one
shuffle of about 5 bytes per shingle: a task sends its shingles by bucket, as 4 bytes each besides the number of the set within its batch,
and gets the shared ones back. The number of buckets follows the number of shingles. The most common shingles are found beforehand, by
a count that is added up in the tasks; they come last in the order and are known to every task (``COMMON`` of them at most), so that no
shingle brings more than a small share of its documents together. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import discard, written
from .text_arrays import NOT_SPACE, distinct_pairs, mix, pieces, shingles, words

SHINGLE, PERCENT = 5, 80
BATCH_BYTES = 6 << 20
#: A shingle is common if a batch has it in so many documents; at most so many are told to the tasks.
OFTEN, COMMON = 16, 1 << 17
#: Shingles of a bucket, on average, and the bits of a shingle that are sent besides those of its bucket: of so many few agree by chance.
PER_BUCKET, TOKEN_BITS = 1 << 21, 32
#: In round r a list is compared with PIVOTS ** r of its members.
PIVOTS = 16
#: Members that are compared with a set in one run, so that a set with many is in several tasks.
PER_RUN = 256
#: Pairs of a pivot and a group that are formed in one part of a list, about.
PER_PART = 1 << 20
#: Documents whose ids may be sent to all tasks: 16 MB at most.
SENT_IDS = 500_000
_A, _B = np.uint64(0x8E9D5AAB2C1F3377), np.uint64(0x1B873593CC9E2D51)
_COMMON_BIT = np.uint64(1 << 63)
_MANY = (1 << 31) - 1
_INFO = -1


def _least_overlap(n, percent: int):
    """Of a set of n, how many a set of that similarity has at least."""
    return (percent * n + 99) // 100


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, the size of each set, and 16 bytes that identify it."""
    doc, hash_ = distinct_pairs(*shingles(words(texts, NOT_SPACE), k))
    n = np.bincount(doc, minlength=len(texts))
    sums = np.zeros((len(texts), 2), np.uint64)
    for j, odd in enumerate((_A, _B)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hash_ ^ odd))])
        end = np.cumsum(n)
        sums[:, j] = mix(total[end] - total[end - n] + n.astype(np.uint64))
    return doc, hash_, n, sums


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _measured(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """A row for each document (doc_id, n, set) and one for each shingle that is common in a batch (token, times)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 1, BATCH_BYTES):
            _, hash_, n, sums = _sets(batch.column(1), k)
            token, times = np.unique(hash_, return_counts=True)
            often = times >= max(OFTEN, len(hash_) // COMMON)
            token, times = token[often], times[often]
            a, b = len(n), len(token)
            ids = pa.concat_arrays([batch.column(0), pa.nulls(b, batch.column(0).type)])
            sets = pa.concat_arrays([_binary(sums), pa.nulls(b, pa.binary())])
            numbers = [np.concatenate([x, y]).astype(np.int64) for x, y in ((n, np.zeros(b, np.int64)), (np.zeros(a, np.int64), token.view(np.int64)), (np.zeros(a, np.int64), times))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a + b) < a), ids, pa.array(numbers[0]), sets, pa.array(numbers[1]), pa.array(numbers[2])], ["document", "doc_id", "n", "set", "token", "times"])

    return docs.mapInArrow(run, f"document boolean, doc_id {kind}, n long, set binary, token long, times long")


def _common(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and the place of each among them from rarer to more common."""
    counted = measured.where("NOT document").groupBy("token").agg(F.sum("times").alias("times"))
    rows = counted.orderBy(F.desc("times"), "token").limit(COMMON).collect()
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    times = np.array([r["times"] for r in rows], np.int64)
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, times))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], place[order]


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in the sorted ``table`` of each value, -1 where it is none."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    bits = np.zeros(1 << 22, bool)
    bits[table & table.dtype.type((1 << 22) - 1)] = True
    maybe = np.flatnonzero(bits[values & values.dtype.type((1 << 22) - 1)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    out = np.full(len(values), -1, np.int64)
    hit = table[at] == values[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers by the significance of their bytes, so that the many zeros stand together."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Packed rows. From a batch to a bucket and back: numbers of the sets within the batch (as steps), entries of each, tokens, and, on the way
#: back, how often each token occurs. About the batch itself, under the key _INFO on the way back: see ``_blocks``.
_PACKED = "key long, batch long, a binary, b binary, c binary, d binary"
_NAMES = ["key", "batch", "a", "b", "c", "d"]


def _packed(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])], _NAMES)


def _owners(owner: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers, packed."""
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    return _planes(np.diff(owner[new], prepend=0)), _planes(np.diff(new, append=len(owner)))


def _blocks(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int, percent: int, bits: int) -> DataFrame:
    """Shingles that aren't common, to the bucket of their first ``bits`` bits; what is known of the sets of a batch past the buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    buckets = 1 << bits

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place = sent.value
        for number, piece in enumerate(pieces(it, 1, BATCH_BYTES)):
            batch = (TaskContext.get().partitionId() << 32) + number
            doc, hash_, n, sums = _sets(piece.column(1), k)
            _, first = np.unique(sums[:, 0], return_index=True)  # equal sets of the batch once
            once = np.zeros(len(n), bool)
            once[first] = True
            once &= n > 0
            local = np.cumsum(once) - 1
            own = once[doc]
            doc, hash_, n, sums = local[doc[own]], hash_[own], n[once], sums[once]
            which = _member(table, hash_)
            plain = which < 0
            n_common = np.bincount(doc[~plain], minlength=len(n))
            # common shingles are in a prefix only where the others don't fill it
            d, c = doc[~plain], which[~plain]
            order = np.lexsort((place[c], d))
            d, c = d[order], c[order]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            need = rank < (n - _least_overlap(n, percent) + 1)[d] - (n[d] - n_common[d])
            d, c = d[need], c[need]
            rows = [(buckets + batch % buckets, batch, sums.tobytes(), _planes(n) + _planes(n_common), table[c].tobytes(), _planes(d) + _planes(place[c]))]
            doc, hash_ = doc[plain], hash_[plain]
            bucket = (hash_ >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, token = doc[order], (hash_[order] << np.uint64(bits) >> np.uint64(64 - TOKEN_BITS)).astype(np.uint32)
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                own = slice(ends[b], ends[b + 1])
                rows.append((b, batch, *_owners(doc[own]), _planes(token[own]), b""))
            yield from _packed(rows).to_batches()

    return docs.mapInArrow(run, _PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of the set and token of every entry."""
    return np.repeat(np.cumsum(_numbers(row["a"]).astype(np.int64)), _numbers(row["b"])), _numbers(row["c"])


def _shared(buckets: int):
    """Of a bucket's shingles those that occur twice or more, with how often, back to where they came from.

    A set that is in several batches comes from each; a set may have a token twice, where two of its shingles agree in it.
    """

    def run(table: pa.Table) -> pa.Table:
        key = table["key"][0].as_py()
        if key >= buckets:
            return table.set_column(0, "key", pa.array(np.full(len(table), _INFO, np.int64)))
        ordered = np.sort(np.concatenate([_numbers(x) for x in table["c"].to_pylist()]))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        times = np.searchsorted(ordered, twice, "right") - np.searchsorted(ordered, twice)
        del ordered
        rows = []
        for row in table.to_pylist():
            owner, token = _unpacked(row)
            at = _member(twice, token)
            some = np.flatnonzero(at >= 0)
            if len(some):
                rows.append((key, row["batch"], *_owners(owner[some]), _planes(token[some]), _planes(times[at[some]])))
        return _packed(rows)

    return run


_PREFIX = "set binary, n long, alone long, tokens array<long>, places array<int>, times array<int>"


def _prefixes(percent: int):
    """Per set of a batch with something in its prefix that occurs twice: n, alone (shingles that occur once), tokens with place and times."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        about = next(r for r in rows if r["key"] == _INFO)
        sums = np.frombuffer(about["a"], np.uint64).reshape(-1, 2)
        half = len(about["b"]) // 2
        n, n_common = (_numbers(about["b"][i * half : (i + 1) * half]).astype(np.int64) for i in (0, 1))
        half = len(about["d"]) // 2
        owner, rank = (_numbers(about["d"][i * half : (i + 1) * half]).astype(np.int64) for i in (0, 1))
        parts = [(owner, (np.frombuffer(about["c"], np.uint64) | _COMMON_BIT), rank + _MANY, np.full(len(owner), _MANY))]
        for r in rows:
            if r["key"] != _INFO:
                owner, token = _unpacked(r)
                times = _numbers(r["d"]).astype(np.int64)
                parts.append((owner, token.astype(np.uint64) | np.uint64(r["key"] << 32), times, times))
        owner, token, order, times = (np.concatenate([p[i] for p in parts]) for i in range(4))
        by = np.lexsort((token, order, owner))
        owner, token, times = owner[by], token[by], times[by]
        alone = n - n_common - np.bincount(owner[times < _MANY], minlength=len(n))
        place = alone[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < (n - _least_overlap(n, percent) + 1)[owner]
        # a token that a set has twice is one entry, at the first of its places
        kept[1:] &= (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        owner, token, place, times = owner[kept], token[kept], place[kept], times[kept]
        who, counts = np.unique(owner, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token.view(np.int64), place.astype(np.int32), times.astype(np.int32))]
        return pa.table({"set": _binary(sums[who]), "n": pa.array(n[who]), "alone": pa.array(alone[who]), "tokens": lists[0], "places": lists[1], "times": lists[2]})

    return run


def prefixes(docs: DataFrame, measured: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The matchable prefix of each distinct set, from doc_id and text: set, n, alone, tokens, places.

    The order of a set's shingles: those that no other set has (``alone`` of them), then by the number of occurrences, then the common ones.
    """
    total = measured.where("document").agg(F.sum("n")).first()[0] or 0
    bits = max(3, min(31, (total // PER_BUCKET).bit_length()))
    blocks = _blocks(docs, _common(measured), k, percent, bits)
    shared = blocks.groupBy("key").applyInArrow(_shared(1 << bits), _PACKED)
    found = shared.groupBy("batch").applyInArrow(_prefixes(percent), _PREFIX)
    # a set in c batches comes c times, and what occurs c times it has alone: these are the first, since all that it has occur that often
    once = found.groupBy("set").agg(F.count("*").cast("int").alias("c"), *(F.first(x).alias(x) for x in ("n", "alone", "tokens", "places", "times")))
    entries = F.arrays_zip("tokens", "places", "times")
    kept = once.select("set", "n", "alone", F.filter(entries, lambda e: e["times"] > F.col("c")).alias("kept"), F.size("tokens").alias("all"))
    kept = kept.where(F.size("kept") > 0)
    return kept.select("set", "n", (F.col("alone") + F.col("all") - F.size("kept")).alias("alone"), F.col("kept.tokens").alias("tokens"), F.col("kept.places").alias("places"))


def _may_reach(a: str, b: str, percent: int) -> Column:
    """Length and positional bounds for the sides ``a`` and ``b`` of a pair that shares a prefix shingle.

    What is in common is the shared shingle, what can stand behind it on both sides, and what can stand before it; the shingles
    that a set has alone come first and are none of it.
    """
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    overlap = F.least(i - F.col(f"{a}.alone"), j - F.col(f"{b}.alone")) + F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * overlap >= percent * (n + m))


def _in_own_prefix(a: str, b: str, percent: int) -> Column:
    """Whether the shared shingle is within what these two sizes need as a prefix, which is shorter for sizes close to each other."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(percent * (n + m) / (100 + percent) - F.lit(1e-9))
    return (F.col(f"{a}.place") <= n - need) & (F.col(f"{b}.place") <= m - need)


def _enough_shared(percent: int) -> Column:
    """Bound by the prefix shingles x and y that both sets have: of the set whose prefix ends first, only what is behind it can be in common
    besides."""
    behind = F.greatest(*(F.floor((percent * F.col(c) + 99) / 100) - 1 for c in ("n", "m")))
    return (100 + percent) * (F.size(F.array_intersect("x", "y")) + behind) >= percent * (F.col("n") + F.col("m"))


def _candidates(docs: DataFrame, measured: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The shingles of the wanted ``sets``: set, shingles."""
    holders = measured.where("document AND n > 0").join(sets, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("holder"))
    ids = written(holders.select("holder").distinct(), "candidate-ids")
    side = F.broadcast(ids) if ids.count() <= SENT_IDS else ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 0):
            doc, hash_, n, sums = _sets(batch.column(0), k)
            ends = (np.concatenate([[0], np.cumsum(n)]) * 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_binary(sums), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(hash_.tobytes())])], ["set", "shingles"])

    # one document of each set, as far as ids differ; what is left is dropped here
    read = docs.join(side, docs["doc_id"].eqNullSafe(ids["holder"]), "left_semi").select("text").mapInArrow(run, "set binary, shingles binary")
    found = written(read.join(sets, "set", "left_semi").groupBy("set").agg(F.first("shingles").alias("shingles")), "candidate-sets")
    discard(ids)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that reach the similarity.

    Rows are sorted so that the shingles of a stand once before those of every b that it is compared with.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_RUN).cast("int").alias("runs"))
    members = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.col("b").alias("set")).join(sets, "set")
    firsts = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("set")).join(sets, "set")
    both = members.select("a", "run", F.lit(1).alias("second"), "set", "shingles").unionByName(firsts.select("a", "run", F.lit(0).alias("second"), "set", "shingles"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in it:
            good = []
            for second, y in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if not second:
                    x = y.copy()
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.repartition("a", "run").sortWithinPartitions("a", "run", "second").mapInArrow(compare, "a binary, b binary")


def _lists(groups: DataFrame) -> DataFrame:
    """list, group, place: groups by the prefix shingles that they share; of lists with the same groups that of the first shingle in order.

    Two groups of similar sets share a prefix shingle, and the bounds hold at every one that they share, so one is enough.
    """
    entries = groups.select("group", "size", F.inline(F.arrays_zip(F.col("tokens").alias("list"), F.col("places").alias("place"))))
    sign = [F.bit_xor(F.xxhash64("group", F.lit(j))).alias(f"x{j}") for j in (0, 1)]
    by_list = entries.groupBy("list").agg(F.sum("size").alias("many"), F.count("*").alias("groups"), *sign, F.min_by("place", "group").alias("first"))
    alike = by_list.where("many > 1").groupBy("groups", "x0", "x1").agg(F.min_by("list", "first").alias("list"))
    return entries.join(alike.select("list"), "list").select("list", "group", "place")


def linked_sets(docs: DataFrame, measured: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The components of the links between sets: (node, root), without the roots themselves."""
    spark = docs.sparkSession
    found = written(prefixes(docs, measured, k, percent).withColumn("group", F.xxhash64("n", "alone", "tokens", "places")), "prefixes")
    groups = written(found.groupBy("group").agg(F.count("*").alias("size"), F.min("set").alias("one"), *(F.first(c).alias(c) for c in ("n", "alone", "tokens", "places"))), "groups")
    lists = written(_lists(groups), "lists")
    met = lists.select("group").distinct()
    people = written(found.join(met, "group", "left_semi").select("set", "group"), "people")
    sets = _candidates(docs, measured, people.select("set"), k)
    bounds = groups.select("group", "n", "alone")
    prefix = groups.select("group", "n", "tokens")

    links, tried, before, least, r = [], [], [], 0, 0
    roots = spark.createDataFrame([], "node binary, root binary")
    while True:
        state = written(people.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")), "state")
        spread = state.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
        listed = written(lists.join(bounds, "group").join(spread, "group"), "listed")
        # lists that have members in different components, and have not yet been compared with all of their members
        open_ = listed.groupBy("list").agg(F.sum("members").alias("many"), F.min("low").alias("l"), F.max("high").alias("h")).where(f"l < h AND many > {least}")
        open_ = written(open_.select("list", "many"), "open-lists")
        most = open_.agg(F.max("many")).first()[0]
        before += [state, listed, open_]
        if most is None:
            break
        todo = listed.join(open_, "list")
        n_pivots = PIVOTS**r
        if r == 0:
            # the most central group first: the one with the smallest share of shingles of its own
            central = todo.groupBy("list").agg(F.first("many").alias("many"), F.min_by(F.struct("group", "n", "alone", "place"), F.struct(F.col("alone") / F.col("n"), "group")).alias("p"))
            pivot = central.select("list", "many", "p.*").join(groups.select("group", F.col("one").alias("set")), "group").withColumn("root", F.col("set"))
        else:
            drawn = F.pmod(F.xxhash64("set", F.lit(r)), F.lit(1 << 32)) / F.lit(float(1 << 32)) * F.col("many") < float(n_pivots)
            pivot = todo.join(state.select("set", "group", "root"), "group").where((F.col("many") <= n_pivots) | drawn)
        # a list with much to compare is in as many parts, each of which meets all of the list's pivots
        parts = F.ceil(F.col("many").cast("double") * F.least("many", F.lit(n_pivots)) / PER_PART).cast("int")
        p = pivot.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).alias("p")
        t = todo.withColumn("part", F.pmod(F.xxhash64("group"), F.greatest(parts, F.lit(1))).cast("int")).alias("t")
        apart = (F.col("t.low") != F.col("t.high")) | (F.col("t.low") != F.col("p.root"))
        each_once = (F.col("t.many") > n_pivots) | ((F.col("p.group") <= F.col("t.group")) & _in_own_prefix("p", "t", percent))
        reach = p.join(t, (F.col("p.list") == F.col("t.list")) & (F.col("p.part") == F.col("t.part")) & apart & each_once & _may_reach("p", "t", percent))
        reach = reach.select("p.set", "p.root", F.col("p.group").alias("g"), F.col("t.group").alias("h")).distinct()
        sides = [prefix.select(F.col("group").alias(g), F.col("n").alias(n), F.col("tokens").alias(x)) for g, n, x in (("g", "n", "x"), ("h", "m", "y"))]
        reach = reach.join(sides[0], "g").join(sides[1], "h").where(_enough_shared(percent)).select("set", "root", "h")
        # the pairs of groups that are left are expanded to their members
        others = state.select(F.col("set").alias("other"), F.col("group").alias("h"), F.col("root").alias("own"))
        pairs = reach.join(others, "h").where("root != own").groupBy(F.least("set", "other").alias("x"), F.greatest("set", "other").alias("y")).agg(F.min("set").alias("a"))
        for t in tried:
            pairs = pairs.join(t, ["x", "y"], "left_anti")
        pairs = pairs.withColumn("b", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")))
        tried.append(written(pairs, "pairs"))
        links.append(written(_verified(tried[-1], sets, percent), "links"))
        every = links[0]
        for x in links[1:]:
            every = every.unionByName(x)
        if r:
            before.append(roots)
        roots = components(every)
        discard(*before)
        before, least, r = [], n_pivots, r + 1
        if most <= n_pivots:
            break
    discard(*before, *links, *tried, found, groups, lists, people, sets)
    return roots


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that it reaches by links.

    Words are runs of anything but ASCII white space, after lower-casing A-Z. A text of fewer than ``k`` words is one shingle as a whole.
    Null, empty and blank texts have no shingles and are linked with nothing: their component is their own id. Rows with equal sets are
    linked, so repeated rows share a component. Null ids count as larger than any other; a component of null ids only has a null id. An
    empty table gives no rows. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured = written(_measured(source, k, kind), "shingle-sets")
    roots = linked_sets(source, measured, k, percent)
    rows = measured.where("document").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    sets = rows.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "root").select("set", "component_id")
    joined = rows.join(by_set, "set", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
