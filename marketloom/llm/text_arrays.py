"""Small vectorized helpers for tasks that work on texts as arrays of bytes: words, their hashes, hashed windows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Words are hashed in stretches of so many bytes; a longer word is a stretch of its own.
STRETCH_BYTES = 1 << 19

# Each idle Python worker would keep the most memory that it has ever used. So freed arrays of a MB or more go back to the system at
# once, those of Arrow too, and what is free between smaller ones whenever a batch is done.
pa.set_memory_pool(pa.system_memory_pool())
#: What a worker remembers between tasks of one operator. Workers outlive a query, so tasks of any other clear it.
REMEMBERED: dict[str, dict] = {}
_trim = None
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
    _trim = ctypes.CDLL(None).malloc_trim


def release() -> None:
    """Give free memory back to the system."""
    if _trim is not None:
        _trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.random.default_rng(2024).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
#: [^\x20\x09-\x0D], by bytes: no byte of a longer UTF-8 sequence is white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def remembered(name: str) -> dict:
    """A new dictionary that outlives tasks, for ``pieces``."""
    return REMEMBERED.setdefault(name, {})


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Cut the batches into slices whose text column holds about ``size`` bytes. Of what is remembered only ``keep`` stays."""
    for name, other in REMEMBERED.items():
        if name != keep:
            other.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch
        release()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more than there are texts). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


@dataclass
class Words:
    """The words of some texts in order: the text each belongs to, where it begins and ends, and its hash."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray

    def first(self) -> np.ndarray:
        """The index of the first word of each text (of the next word, if it has none)."""
        return np.cumsum(self.count) - self.count


def words(texts: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """The maximal runs of bytes of ``kind`` in each text, lower-cased (A-Z) if asked, with a 64-bit hash each."""
    data, offsets = raw(texts)
    if lower:
        data = LOWER_ASCII[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    stops = ~inside
    stops[cut] = True
    marks = np.flatnonzero(stops)
    end = marks[np.searchsorted(marks, start, "right")] if len(start) else start
    hash_ = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # by stretches, so that the 64-bit numbers take little memory beside the bytes
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + STRETCH_BYTES, "right")))
        n = int(end[to - 1] - low)
        power, inverse = _power_tables(max(n, STRETCH_BYTES) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        hash_[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD[63])
        at = to
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, doc, start, end, hash_, np.bincount(doc, minlength=len(texts))[: len(texts)])


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every window of ``k`` words within a text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    total = np.full(len(at), k, np.uint64) * _ODD[62]
    for j in range(k):
        total += w.hash[at + j] * _ODD[j % 60]
        if j % 60 == 59:
            total = mix(total)
    return at, mix(total)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every ``k``-word shingle; a shorter text that has words is one shingle as a whole."""
    at, hash_ = windows(w, k)
    docs, hashes = [w.doc[at]], [hash_]
    first = w.first()
    for n in range(1, k):
        short = np.flatnonzero(w.count == n)
        total = np.full(len(short), n, np.uint64) * _ODD[62]
        for j in range(n):
            total += w.hash[first[short] + j] * _ODD[j]
        docs.append(short)
        hashes.append(mix(total))
    return np.concatenate(docs), np.concatenate(hashes)


def distinct_pairs(doc: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, by text, then hash."""
    order = np.lexsort((hash_, doc))
    doc, hash_ = doc[order], hash_[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
    return doc[new], hash_[new]
