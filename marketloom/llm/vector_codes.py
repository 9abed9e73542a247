"""Product codes of vectors: every part of a vector as the number of its nearest codebook entry, with bounds that spare exact scans.

All arithmetic is on integers, so results don't depend on the order of rows. Each round is one pass over the vectors: parts are assigned, and
each task adds up its parts by entry, from which the driver makes the next codebooks. Besides its code, a vector keeps for each part and each of
``GROUPS`` groups of entries a lower bound of the distance to the nearest other entry of the group, and the round in which that was exact. As all
codebooks are kept, a bound of round s is less in round t by how far the group's entries are from where they stood in s, which is no
more than the sum of all steps in between. A group whose bound is still beyond the distance to the own entry isn't scanned.

How it scales: rows are never moved between tasks; a task sends one row of sums, of the size of the codebooks, however many vectors it has.
What goes to all tasks are the codebooks of all rounds, whose size doesn't depend on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Groups of a codebook's entries, each with a bound.
GROUPS = 4
#: Integers are cut to this range, so that squared distances of a vector of 256 components fit 64 bits.
LIMIT = 1 << 26
SCALE = 256
#: Vectors that are compared with the codebooks at once.
BLOCK = 4096
#: Sums of up to so many labels are sent to all tasks; beyond, they are joined in ``SALTS`` parts.
SENT_LABELS, SALTS = 200_000, 32
#: Share by which a bound must exceed a distance, far above the errors of roots and differences.
SLACK = 1e-9


def integers(vectors: np.ndarray) -> np.ndarray:
    """Floors of 256 times the components."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, p) to entries (k, p)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:  # whole numbers below 2**53 are exact in floating point too
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def groups(k: int) -> list[slice]:
    """The groups of ``k`` entries that aren't empty."""
    edges = [g * k // GROUPS for g in range(GROUPS + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def _below(roots: np.ndarray) -> np.ndarray:
    """As 32-bit numbers that are no greater."""
    return np.nextafter(roots.astype(np.float32), np.float32(-np.inf))


class Codes:
    """Codes and bounds of some vectors: ``code`` (n, parts), ``low`` and ``stamp`` (n, parts, groups)."""

    def __init__(self, n: int, parts: int, n_groups: int) -> None:
        self.code = np.zeros((n, parts), np.uint8)
        self.low = np.full((n, parts, n_groups), np.inf, np.float32)
        self.stamp = np.zeros((n, parts, n_groups), np.uint8)
        self.distance = np.zeros((n, parts), np.int64)
        self.scanned = 0  # groups that were compared exactly


def first_codes(x: np.ndarray, books: np.ndarray) -> Codes:
    """Codes of vectors (n, parts, p) by scanning all entries of books (parts, k, p)."""
    n, parts, _ = x.shape
    lots = groups(books.shape[1])
    out, rows = Codes(n, parts, len(lots)), np.arange(n)
    for m in range(parts):
        d = distances(x[:, m], books[m])
        own = d.argmin(axis=1)  # the first of equal ones
        out.code[:, m], out.distance[:, m] = own, d[rows, own]
        others = np.sqrt(d.astype(np.float64))
        others[rows, own] = np.inf
        for g, lot in enumerate(lots):
            out.low[:, m, g] = _below(others[:, lot].min(axis=1))
    out.scanned = n * parts * len(lots)
    return out


def next_codes(x: np.ndarray, history: np.ndarray, old: Codes) -> Codes:
    """The same for the last books of the history (rounds, parts, k, p), scanning only groups whose bound doesn't rule them out."""
    n, parts, _ = x.shape
    now, lots = len(history) - 1, groups(history.shape[2])
    out, rows = Codes(n, parts, len(lots)), np.arange(n)
    steps = history[:-1].astype(np.float64) - history[-1]
    moved = np.sqrt((steps**2).sum(axis=3))  # of every entry since each round, as the crow flies
    for m in range(parts):
        books, own = history[-1, m], old.code[:, m].astype(np.int64)
        exact = ((x[:, m] - books[own]) ** 2).sum(axis=1)
        root = np.sqrt(exact.astype(np.float64))
        best, where = exact.copy(), own.copy()
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g, lot in enumerate(lots):
            low, since = old.low[:, m, g].astype(np.float64), old.stamp[:, m, g]
            drift = moved[:, m, lot].max(axis=1)[since]
            out.low[:, m, g], out.stamp[:, m, g] = old.low[:, m, g], since
            todo = np.flatnonzero(~(root * (1 + SLACK) < (low - drift) - SLACK * (np.where(np.isinf(low), 0, low) + drift)))
            if not len(todo):
                continue
            d = distances(x[todo, m], books[lot])
            seen[g] = (todo, d)
            out.scanned += len(todo)
            at = d.argmin(axis=1)
            least, entry = d[np.arange(len(todo)), at], at + lot.start
            nearer = (least < best[todo]) | ((least == best[todo]) & (entry < where[todo]))
            best[todo[nearer]], where[todo[nearer]] = least[nearer], entry[nearer]
        left = where != own
        for g, lot in enumerate(lots):
            if g in seen:
                todo, d = seen[g]
                others = np.sqrt(d.astype(np.float64))
                inside = np.flatnonzero((where[todo] >= lot.start) & (where[todo] < lot.stop))
                others[inside, where[todo[inside]] - lot.start] = np.inf
                out.low[todo, m, g], out.stamp[todo, m, g] = _below(others.min(axis=1)), now
            # the entry that a part has left counts among its group's others, as of now
            mine = left & (own >= lot.start) & (own < lot.stop)
            if g in seen:
                mine[seen[g][0]] = False
            if mine.any():
                low, drift = old.low[mine, m, g].astype(np.float64), moved[:, m, lot].max(axis=1)[old.stamp[mine, m, g]]
                out.low[mine, m, g], out.stamp[mine, m, g] = _below(np.minimum(low - drift - SLACK * (np.where(np.isinf(low), 0, low) + drift), root[mine])), now
        out.code[:, m], out.distance[:, m] = where, best
    return out


def sums(x: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """(parts, k, 1 + p): how many parts have each entry, and their sum by component."""
    n, parts, p = x.shape
    out = np.zeros((parts, k, 1 + p), np.int64)
    for m in range(parts):
        out[m, :, 0] = np.bincount(code[:, m], minlength=k)
        for i in range(p):
            out[m, :, 1 + i] = np.bincount(code[:, m], x[:, m, i].astype(np.float64), k).astype(np.int64)  # below 2**53 in a block
    return out


def moved_books(books: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of the mean of their parts; unused ones stay."""
    n = total[:, :, :1]
    return np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)


_STATE = "numbers binary, code binary, low binary, stamp binary, sums array<long>, scanned long"


def _codes(batch: pa.RecordBatch, shape: tuple[int, int, int], k: int) -> tuple[np.ndarray, Codes]:
    """The vectors and codes of a batch of stored rows."""
    n, parts, p = shape
    joined = lambda name, kind: np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), kind)
    n_groups = len(groups(k))
    old = Codes(0, parts, n_groups)
    old.code = joined("code", np.uint8).reshape(n, parts)
    old.low = joined("low", "<f4").reshape(n, parts, n_groups)
    old.stamp = joined("stamp", np.uint8).reshape(n, parts, n_groups)
    return joined("numbers", "<i4").reshape(n, parts, p).astype(np.int64), old


def _round(rows: DataFrame, history: np.ndarray, kinds: str, final: bool = False) -> DataFrame:
    """One pass over vectors (``numbers``, or a round's state): the new state and each task's sums, or codes and errors."""
    sent = rows.sparkSession.sparkContext.broadcast(history)
    _, parts, k, p = history.shape

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total, scanned, schema = np.zeros((parts, k, 1 + p), np.int64), 0, None
        for whole in it:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                names, n = batch.schema.names, batch.num_rows
                schema = batch.schema
                if len(books) == 1:
                    lists = batch.column(2)
                    if not (lists.value_lengths().to_numpy() == parts * p).all():
                        raise ValueError(f"all vectors must have {parts * p} components")
                    x = integers(lists.flatten().to_numpy()).reshape(n, parts, p)
                    found = first_codes(x, books[0])
                else:
                    x, old = _codes(batch, (n, parts, p), k)
                    found = next_codes(x, books, old)
                ids = [batch.column(names.index(c)) for c in ("vec_id", "label")]
                if final:
                    hexed = [r.tobytes().hex() for r in found.code]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(hexed), pa.array(found.distance.sum(axis=1))], ["vec_id", "label", "code", "error"])
                    continue
                scanned += found.scanned
                total += sums(x, found.code, k)
                state = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype("<i4"), found.code, found.low.astype("<f4"), found.stamp)]
                yield pa.RecordBatch.from_arrays([*ids, *state, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], ["vec_id", "label", *(c.split()[0] for c in _STATE.split(", "))])
        if schema is not None and not final:
            nulls = [pa.nulls(1, schema.field(c).type) for c in ("vec_id", "label")] + [pa.nulls(1, pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([total.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned])], ["vec_id", "label", *(c.split()[0] for c in _STATE.split(", "))])

    return rows.mapInArrow(assign, f"{kinds}, " + ("code string, error long" if final else _STATE))


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector has finite components only."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & finite)


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(parts, k, p): the parts of the vectors with the smallest ids. Of rows with one id the least vector counts; no id comes last."""
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    own = F.broadcast(ids.withColumnRenamed("vec_id", "first_id"))
    rows = kept.join(own, F.col("vec_id").eqNullSafe(F.col("first_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    if not rows:
        return None
    lengths = {len(r["embedding"]) for r in rows}
    if len(lengths) > 1 or min(lengths) % parts or not min(lengths):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return integers(np.array([r["embedding"] for r in rows])).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]] | None:
    """(state after the last round, codebooks of all rounds, groups scanned in each round); nothing where there are no vectors."""
    books = first_books(kept, parts, entries)
    if books is None:
        return None
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "embedding")
    history, state, scanned = books[None], kept.select("vec_id", "label", "embedding"), []
    for r in range(rounds):
        before = state
        state = written(_round(state.where("sums IS NULL").drop("sums", "scanned") if r else state, history, kinds), "codes")
        if r:
            discard(before)
        added = state.where("sums IS NOT NULL")
        total = np.zeros(books.size // books.shape[2] * (1 + books.shape[2]), np.int64)
        for at, n in added.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():  # a row for each number of the codebooks
            total[at] = n
        scanned.append(added.agg(F.sum("scanned")).first()[0])
        books = moved_books(books, total.reshape(*books.shape[:2], -1))
        history = np.concatenate([history, books[None]])
    return state, history, scanned


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or has components that are null or not finite are dropped. Repeated rows are kept, and weigh as often in the
    codebooks' means; ids and labels may be null. With fewer ids than entries the codebooks are smaller. Components beyond 2**18 count as
    that. Vectors of different lengths, or of a length that the parts don't divide, raise. Without vectors there are no rows. Other columns
    are ignored.
    """
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    label = vectors.schema[label_col].dataType.simpleString()
    found = fit(kept, parts, entries, rounds)
    if found is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    state, history, _ = found
    kinds = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, label {label}"
    coded = written(_round(state.where("sums IS NULL").drop("sums", "scanned"), history, kinds, final=True), "coded")
    if rounds:
        discard(state)
    sha = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest()
    totals = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= SENT_LABELS:
        joined = coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("own")))
    else:
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
        copies = totals.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = coded.withColumn("salt", salt).join(copies, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("own_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
