"""Sharding: minimax contiguous partition of atomic groups, DataFrame operations only.

Rows with equal texts form one atomic group. Groups stand in the order of a 64-bit hash of their text. The smallest
capacity is searched for which a greedy walk over the ordered group sizes needs at most ``n_shards`` shards; the shards
are cut where that walk cuts.

How it scales: group sizes come from a partially aggregated ``groupBy`` (a hot text is one row per map task), running
sums are taken per cell (the leading bits of the hash, so that cells are even) plus an offset per cell. The groups are written in
the order of the cells, so that a step reads the files of a few cells only. The driver holds the totals of the cells, of which there are
1,024 up to a thousand million rows and 2**20 at most, and the bounds of the capacities tried at once. One Spark job answers
one greedy step for ``PROBES`` capacities together, so a search over a range R takes about log(R)/log(PROBES) rounds of
``n_shards`` - 1 jobs.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written

#: Bits of a cell at least and at most, and rows of a cell above the least; parts that each is divided into when slots are numbered (a hot
#: text is spread over them).
CELL_BITS, CELL_ROWS, SALTS = (10, 20), 1 << 20, 16
#: Numbers of cells and parts that are sent to all tasks at most.
SENT = 1 << 16
#: Capacities tried at once.
PROBES = 128


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # a null text is a group of its own
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
    )


def _cell(h: Column, bits: int) -> Column:
    return F.shiftright(h, 64 - bits).cast("int")


class _OrderedSizes:
    """The ordered group sizes: running sums on Spark, totals of the cells on the driver."""

    def __init__(self, rows: DataFrame, bits: int) -> None:
        self.width = 64 - bits
        groups = rows.groupBy("h").agg(F.sum("size").alias("size")).withColumn("cell", _cell(F.col("h"), bits)).repartitionByRange("cell")
        running = F.sum("size").over(Window.partitionBy("cell").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
        self.groups = written(groups.select("cell", "h", "size", running.alias("upto")), "shard-groups")
        self.spark = rows.sparkSession
        self.cells, self.before, self.total, self.largest = [], [], 0, 0
        for r in sorted(self.groups.groupBy("cell").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()):
            self.cells.append(r["cell"])
            self.before.append(self.total)
            self.total += r["n"]
            self.largest = max(self.largest, r["most"])

    def last_within(self, bounds: list[int]) -> list[tuple[int, int]]:
        """For each bound: the largest running sum within it and the hash of the group that reaches it."""
        out, ask = [], []
        for k, bound in enumerate(bounds):
            at = bisect_right(self.before, bound) - 1
            after = self.before[at + 1] if at + 1 < len(self.before) else self.total
            if after <= bound:
                out.append((after, self._end(at)))
            else:
                out.append((self.before[at], self._end(at - 1) if at else self._end(0) - (1 << self.width)))
                ask.append((k, self.cells[at], bound - self.before[at], at))
        if ask:
            k, cell, x = (", ".join(str(a[i]) for a in ask) for i in range(3))
            lists = self.spark.range(1).selectExpr(f"array({k}) AS k", f"array({cell}) AS cell", f"transform(array({x}), v -> cast(v AS bigint)) AS x")
            asked = lists.select(F.inline(F.arrays_zip("k", "cell", "x")))
            found = (
                self.groups.where(F.col("cell").isin(sorted({c for _, c, _, _ in ask})))
                .join(F.broadcast(asked), "cell")  # PROBES rows at most
                .where("upto <= x")
                .groupBy("k")
                .agg(F.max(F.struct("upto", "h")).alias("last"))
                .collect()
            )
            ats = {k: at for k, _, _, at in ask}
            for r in found:
                out[r["k"]] = (self.before[ats[r["k"]]] + r["last"]["upto"], r["last"]["h"])
        return out

    def _end(self, at: int) -> int:
        """The largest hash of a cell."""
        return ((self.cells[at] + 1) << self.width) - 1

    def greedy(self, capacities: list[int], n_shards: int) -> list[list[tuple[int, int]] | None]:
        """For each capacity the cuts of the greedy walk, or None if it needs more than ``n_shards`` shards."""
        cuts: list[list[tuple[int, int]]] = [[] for _ in capacities]
        for _ in range(n_shards):
            open_ = [k for k, c in enumerate(cuts) if not c or c[-1][0] < self.total]
            if not open_:
                break
            for k, cut in zip(open_, self.last_within([(cuts[k][-1][0] if cuts[k] else 0) + capacities[k] for k in open_]), strict=True):
                cuts[k].append(cut)
        return [c if c and c[-1][0] >= self.total else None for c in cuts]


def minimax_cuts(sizes: _OrderedSizes, n_shards: int) -> list[int]:
    """Hashes after which a shard ends, by the smallest feasible capacity."""
    if not sizes.total:
        return []
    low = max(-(-sizes.total // n_shards), sizes.largest)
    high = -(-sizes.total // n_shards) + sizes.largest  # always feasible
    best = None
    while best is None or low < high:
        tried = sorted({low + (high - low) * j // (PROBES - 1) for j in range(PROBES)})
        results = sizes.greedy(tried, n_shards)
        first = next(k for k, r in enumerate(results) if r is not None)
        best, high = results[first], tried[first]
        low = tried[first - 1] + 1 if first else high
    return [h for _, h in best[:-1]]


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal the rows of ``docs`` into ``n_shards`` shards of nearly equal bytes; equal texts share a shard.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law). ``slot`` numbers the
    rows of a shard from 0 without gaps, in the order of hash cell, part, hash and doc_id; rows that agree in all of these
    are numbered in any order.

    A null text has size 1 and the CRC of no bytes; all null texts are one group. An empty text has size 1. A null id is
    kept. Repeated rows are all kept. A text longer than a fair share makes its shard larger and may leave later shards
    empty. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    # parts by the number of a row, so that rows that agree in everything are in several too
    part = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = written(_measured(docs, id_col, text_col).withColumn("part", part), "shard-rows")
    low, high = CELL_BITS
    bits = max(low, min(high, (rows.count() // CELL_ROWS).bit_length()))
    sizes = _OrderedSizes(rows, bits)
    cuts = minimax_cuts(sizes, n_shards)
    discard(sizes.groups)
    number = sum(((F.col("h") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = rows.withColumns({"shard": number, "cell": _cell(F.col("h"), bits)})
    counted = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # (cells + n_shards) * SALTS rows at most
    starts = F.broadcast(starts) if ((1 << bits) + n_shards) * SALTS <= SENT else starts
    inside = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("h", "doc_id")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["shard", "cell", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("inside")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
