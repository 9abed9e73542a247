"""Prefix trie of conversations by sorted sequences, longest common prefixes and range minima.

A conversation is the sequence of the hashes of its turns. Sorted by these, the members of a node, which is a distinct prefix, stand in one interval.
Of neighbours the length of the common prefix is known; a sparse table over these lengths answers the least of any range at once, so
every candidate (row, depth) finds the left and the right end of its interval by two binary searches of its own, many candidates at a time and without
a stack. Rows and depths in order are the nodes in preorder: what is summed over a subtree is a difference of two running sums.

How it scales: a row is 16 bytes of hash and 8 of words per turn. Rows are dealt by ranges of sequence and id, so copies of one conversation
are many partitions if they have to be. A node that is no prefix of the first or last row of its partition is whole in there. The others, a
path or two for each partition, meet in a second, small run of the same tables over these boundary rows, a ten thousandth of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written

#: Bytes of a turn's hash.
WIDTH = 16
#: Conversations and turns of a partition, about.
ROWS, TURNS = 20_000, 500_000
#: Candidates that are searched for together.
BLOCK = 1 << 18
#: Ids of members that end at one node are passed on in pieces of so many.
PIECE_IDS = 1 << 15
#: Up to so many parents on the borders of partitions are sent to all tasks; beyond, they are joined by partition.
SENT_PARENTS = 200_000
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, sequence, words): every conversation c as the first h turns of c - c % ``block``, then its own after its first h,
    with h = crc32(c) % ``heads``. ``sequence`` has 16 bytes of SHA-256 for each turn's role and text, ``words`` its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # with the length of the role in front, no other pair gives the same bytes
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    of = F.col("conv_id") - F.col("conv_id") % block
    rows = turns.where("conv_id IS NOT NULL").select(of.alias("block"), F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    # one shuffle by block serves the grouping and the window
    ordered = rows.repartition("block").groupBy("block", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "words"))).alias("own"))
    source = F.first(F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, heads - 1)), ignorenulls=True).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    head = F.coalesce(F.slice(F.col("source"), 1, F.col("h")), F.array().cast("array<struct<turn: bigint, key: binary, words: bigint>>"))
    whole = ordered.withColumns({"source": source, "h": h}).select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.size("own"))).alias("whole"))
    return whole.select("conv_id", F.array_join(F.transform("whole", lambda t: F.hex(t["key"])), "").alias("sequence"), F.col("whole.words").alias("words")).withColumn("sequence", F.unhex("sequence"))


class RangeMinimum:
    """Least value of any range of an array: minima of all ranges of a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [begin, end), which must not be empty."""
        out = np.empty(len(begin), self.levels[0].dtype)
        level = np.frexp((end - begin).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][begin[own]], self.levels[k][end[own] - (1 << k)])
        return out


def _turns(sequences: list[bytes]) -> np.ndarray:
    """The hashes of all turns, two numbers each."""
    return np.frombuffer(b"".join(sequences) or bytearray(), np.uint64).reshape(-1, WIDTH // 8)


def common_turns(offsets: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Of every row the turns that it begins with like the row before; 0 for the first. ``turns`` are all rows' turns in a row."""
    length = np.diff(offsets)
    out = np.zeros(len(length), np.int64)
    if len(length) < 2:
        return out
    both = np.minimum(length[1:], length[:-1])
    start = np.cumsum(both) - both
    step = np.arange(both.sum()) - np.repeat(start, both)
    equal = (turns[np.repeat(offsets[:-2], both) + step] == turns[np.repeat(offsets[1:-1], both) + step]).all(axis=1)
    # the first turn that differs, or all
    place = np.where(equal, np.repeat(both, both), step)
    some = both > 0
    if some.any():
        out[1:][some] = np.minimum.reduceat(place, start[some])
    return out


class Trie:
    """Nodes of sorted rows of ``length`` turns each, ``common`` of them shared with the row before: candidates (row, depth), in preorder.

    A candidate is a prefix that the row before doesn't begin with, so each node is one candidate; the root belongs to the first row.
    """

    def __init__(self, length: np.ndarray, common: np.ndarray) -> None:
        self.length, self.common = length, common.copy()
        self.common[0] = -1  # of row 0 all depths are new, 0 among them
        new = length - self.common
        self.base = np.concatenate([[0], np.cumsum(new)])  # of each row its first node
        self.row = np.repeat(np.arange(len(length)), new)
        self.depth = np.arange(self.base[-1]) - np.repeat(self.base[:-1] - self.common - 1, new)
        self.lcp = RangeMinimum(self.common.astype(np.int32))
        self.right = np.empty(len(self.row), np.int64)
        self.parent = np.empty(len(self.row), np.int64)
        for at in range(0, len(self.row), BLOCK):
            own = slice(at, at + BLOCK)
            row, depth = self.row[own], self.depth[own]
            self.right[own] = self.last_row(row, depth)
            self.parent[own] = np.where(depth > 0, self.node(row, np.maximum(depth - 1, 0)), -1)

    def last_row(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that begins with the first ``depth`` turns of ``row``: as far as no shared prefix is shorter."""
        low, high = row.copy(), np.full(len(row), len(self.length) - 1)
        while (open_ := low < high).any():
            middle = (low[open_] + high[open_] + 1) // 2
            inside = self.lcp.least(row[open_] + 1, middle + 1) >= depth[open_]
            low[open_] = np.where(inside, middle, low[open_])
            high[open_] = np.where(inside, high[open_], middle - 1)
        return low

    def first_row(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that begins with the first ``depth`` turns of ``row``."""
        low, high = np.zeros(len(row), np.int64), row.copy()
        while (open_ := low < high).any():
            middle = (low[open_] + high[open_]) // 2
            inside = self.lcp.least(middle + 1, row[open_] + 1) >= depth[open_]
            high[open_] = np.where(inside, middle, high[open_])
            low[open_] = np.where(inside, low[open_], middle + 1)
        return low

    def node(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node of the first ``depth`` turns of ``row``."""
        first = self.first_row(row, depth)
        return self.base[first] + depth - self.common[first] - 1

    def path(self, row: int) -> np.ndarray:
        """The nodes from the root to the whole row."""
        depth = np.arange(self.length[row] + 1)
        return self.node(np.full(len(depth), row), depth)

    def subtree_sum(self, values: np.ndarray) -> np.ndarray:
        """Of every node the sum over the nodes below it and itself, which follow each other in preorder."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.base[self.right + 1]] - total[:-1]

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[self.parent >= 0], minlength=len(self.row))


_LOCAL = (
    "kind int, part int, conv_id long, depth long, parent_side int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "side int, sequence binary, words array<long>, least array<long>, members array<long>, inner array<long>, leaves array<long>, saved array<long>, chunk int, ids string"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_FIELDS = {f.split()[0]: _TYPES[f.split()[1]] for f in _LOCAL.split(", ")}
#: Kinds of rows of a partition: a node that is whole in it, a first or last row with its path's nodes, ids of members that end at such a node.
NODE, BORDER, ENDS = 0, 1, 2


def _batch(n: int, **columns) -> pa.RecordBatch:
    given = {k: pa.array(v, _FIELDS[k]) if not isinstance(v, int) else pa.array(np.full(n, v), _FIELDS[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, t) for k, t in _FIELDS.items()], [*_FIELDS])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), offsets - offsets[0]


def _partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one sorted partition (conv_id, sequence, words)."""
    batches = [b for b in it if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    part = TaskContext.get().partitionId()
    conv = table["conv_id"].to_numpy()
    words, offsets = _flat(table["words"].combine_chunks())
    sequences = table["sequence"]
    trie = Trie(np.diff(offsets), common_turns(offsets, _turns(sequences.to_pylist())))
    n, last = len(trie.row), len(conv) - 1
    members = trie.right - trie.row + 1
    least = RangeMinimum(conv).least(trie.row, trie.right + 1)
    own_words = np.where(trie.depth > 0, np.concatenate([words, [0]])[np.maximum(offsets[trie.row] + trie.depth - 1, 0)], 0)
    # prefixes of the first or last row may go on in other partitions
    side = np.zeros(n, np.int32)
    first_path, last_path = trie.path(0), trie.path(last)
    side[last_path] = 2
    side[first_path] = 1
    whole = side == 0
    kids = trie.children()
    leaves = trie.subtree_sum((whole & (kids == 0)).astype(np.int64))
    saved = trie.subtree_sum(np.where(whole, (members - 1) * own_words, 0))
    # members that end at a node stand first in its interval, by id
    ends = np.flatnonzero(trie.depth == trie.length[trie.row])
    digest = np.full(n, _NONE, object)
    own_rows = np.append(trie.row[ends][1:], len(conv))  # rows without a node of their own repeat the row before
    pieces: list[tuple[int, int, int, str]] = []
    for node, stop in zip(ends.tolist(), own_rows.tolist(), strict=True):
        ids = conv[trie.row[node] : stop]
        if whole[node]:
            digest[node] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
        else:
            pieces += [(int(side[node]), int(trie.depth[node]), k, ",".join(map(str, ids[at : at + PIECE_IDS].tolist()))) for k, at in enumerate(range(0, len(ids), PIECE_IDS))]
    up = trie.parent
    for at in range(0, n, 1 << 16):
        own = np.flatnonzero(whole[at : at + (1 << 16)]) + at
        if len(own):
            # within the partition the smallest member of a whole parent is known
            yield _batch(
                len(own), kind=NODE, part=part, conv_id=least[own], depth=trie.depth[own], parent_side=side[up[own]], parent_conv_id=least[up[own]], n_convs=members[own],
                n_children=kids[own], n_leaves=leaves[own], saved_tokens=saved[own], ends_sha256=digest[own].tolist(),
            )
    inner = np.bincount(up[whole & (up >= 0)], minlength=n)
    for k, row, path in ((1, 0, first_path), (2, last, last_path)):
        path = path[side[path] == k] if k == 2 else path
        yield _batch(
            1, kind=BORDER, part=part, side=k, sequence=[sequences[row].as_py()], words=[words[offsets[row] : offsets[row + 1]]], depth=[int(trie.depth[path[0]]) if len(path) else 0],
            least=[least[path]], members=[members[path]], inner=[inner[path]], leaves=[leaves[path]], saved=[saved[path]],
        )
    for s, depth, k, ids in pieces:
        yield _batch(1, kind=ENDS, part=part, side=s, depth=[depth], chunk=k, ids=[ids])


def _borders(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all border rows, whole at last, each with the (part, side, depth) by which partitions know it."""
    rows = [r for b in it for r in b.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: (r["sequence"], r["part"], r["side"]))
    lengths = np.array([len(r["words"]) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    trie = Trie(lengths, common_turns(offsets, _turns([r["sequence"] for r in rows])))
    n = len(trie.row)
    total = {k: np.zeros(n, np.int64) for k in ("members", "inner", "leaves", "saved")}
    least = np.full(n, np.iinfo(np.int64).max)
    named: list[tuple[np.ndarray, int, int]] = []
    for k, r in enumerate(rows):
        path = trie.path(k)[r["depth"] : r["depth"] + len(r["least"])]
        named.append((path, r["part"], r["side"]))
        for name, sums in total.items():
            sums[path] += np.array(r[name], np.int64)
        least[path] = np.minimum(least[path], np.array(r["least"], np.int64))
    words = np.concatenate([np.array(r["words"], np.int64) for r in rows] + [np.zeros(1, np.int64)])
    own_words = np.where(trie.depth > 0, words[np.maximum(offsets[trie.row] + trie.depth - 1, 0)], 0)
    kids = total["inner"] + trie.children()
    leaves = total["leaves"] + trie.subtree_sum((kids == 0).astype(np.int64))
    saved = total["saved"] + trie.subtree_sum((total["members"] - 1) * own_words)
    parent = np.where(trie.parent >= 0, least[trie.parent], 0)
    seen = np.zeros(n, bool)
    for path, part, side in named:
        new = ~seen[path]
        seen[path] = True
        d = trie.depth[path]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (path, np.full(len(path), part, np.int32), np.full(len(path), side, np.int32), new, least[path], d)]
            + [pa.array(parent[path], mask=d == 0)]
            + [pa.array(x[path]) for x in (total["members"], kids, leaves, saved)],
            ["node", "part", "side", "once", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"],
        )


_BORDER_NODES = "node long, part int, side int, once boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose pieces come in order; nothing but its state is held."""
    node, state = None, None
    for batch in it:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(sequences: DataFrame, rows: int = ROWS, turns: int = TURNS) -> DataFrame:
    """Per distinct prefix of (conv_id, sequence, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Ids must be unique and not null; a sequence may be empty. Without rows there are no nodes, not even a root. The turns of one conversation
    are a row, so they must fit a task; members, copies and children of a node needn't.
    """
    convs = written(sequences.select("conv_id", "sequence", "words"), "conversations")
    n, t = convs.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    parts = max(1, -(-n // rows), -(-t // turns))
    local = written(convs.repartitionByRange(parts, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(_partition, _LOCAL), "nodes")
    border = local.where(F.col("kind") == BORDER).select("part", "side", "depth", "sequence", "words", "least", "members", "inner", "leaves", "saved")
    known = written(border.coalesce(1).mapInArrow(_borders, _BORDER_NODES), "borders")
    discard(convs)
    name = ["part", "side", "depth"]
    # ids that end at a node on a border, piece by piece in the order of partitions
    ends = local.where(F.col("kind") == ENDS).select(*name, "chunk", "ids").join(known.select(*name, "node"), name)
    digests = ends.repartition("node").sortWithinPartitions("node", "part", "chunk").select("node", "ids").mapInArrow(_digests, "node long, ends_sha256 string")
    whole = known.where("once").join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).select(_RESULT)
    parents = known.select(*name, F.col("conv_id").alias("up"))
    if known.count() <= SENT_PARENTS:
        parents = F.broadcast(parents)
    inner = local.where(F.col("kind") == NODE)
    first = inner.where("parent_side = 0").select(_RESULT)
    crossing = inner.where("parent_side > 0").withColumns({"up_depth": F.col("depth") - 1})
    crossing = crossing.join(parents.withColumnsRenamed({"depth": "up_depth", "side": "parent_side"}), ["part", "parent_side", "up_depth"]).withColumn("parent_conv_id", F.col("up")).select(_RESULT)
    return whole.unionByName(first).unionByName(crossing)


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns.

    Rows without a conversation id belong to none and are left out. Null roles and texts are empty; null turns come first; turns with one number, and
    repeated rows, are all kept, in the order of their hashes. A conversation without turns after rebuilding ends at the root. An empty table
    gives no rows. Other columns are ignored.
    """
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return trie(rebuilt(source))
