"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum, over all ways to cut it into pieces of the vocabulary, of the products of the
pieces' probabilities there; a forward pass sums them all. The piece probabilities are fitted by expectation-maximisation, whose
expected counts come from the same sum. Fitting sees a bounded, documented sample of labelled rows, as counts of words by language; scoring runs over
all rows where they are, each batch scoring its distinct words once, for words of equal length together. A task remembers the words that it has
scored, up to ``REMEMBERED`` of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_sample
from .text_arrays import mix, pieces, remembered

#: Labelled rows that the probabilities are fitted on, those with the smallest hash of their id and text.
TRAIN_ROWS = 4_000
EPOCHS, SMOOTHING, UNKNOWN = 3, 0.1, 1e-7
#: Sums are scaled at every so many characters, before a product of probabilities can underflow.
SCALED = 16
#: Words that a task remembers with their scores, and characters of the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
BATCH_BYTES = 8 << 20
#: Languages that are scored together.
LANGUAGES = 16
#: Words are scored together while they have so many characters, or one by one.
TOGETHER = 1 << 18
BEGIN = "▁"
_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower())


class Pieces:
    """The vocabulary's pieces that consist of letters, found by hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(x for x in names if x and all(c.isalpha() or c == BEGIN for c in x))
        self.longest = max(map(len, self.names))
        hashes = np.array([self._hashes(np.array([list(map(ord, x))], np.uint64), len(x))[-1][0, 0] for x in self.names], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def _hashes(chars: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """For every length the hashes of the stretches of that many characters, by word and begin."""
        total = np.zeros(chars.shape, np.uint64)
        out = []
        for n in range(1, min(longest, chars.shape[1]) + 1):
            total = mix(total[:, : chars.shape[1] - n + 1] * _ODD + chars[:, n - 1 :] + np.uint64(1))
            out.append(total)
        return out

    def ids(self, chars: np.ndarray) -> list[np.ndarray]:
        """For words of equal length, by length of the piece: the piece at every begin, -1 where there is none."""
        out = []
        for total in self._hashes(chars, self.longest):
            found = np.full(total.shape, -1, np.int64)
            maybe = np.nonzero(self.bits[total & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.sorted, total[maybe]), len(self.sorted) - 1)
            found[maybe] = np.where(self.sorted[at] == total[maybe], self.order[at], -1)
            out.append(found)
        return out


_pieces: dict[str, Pieces] = remembered("pieces")


def _of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


@dataclass
class Model:
    """Per language the pieces that its sample has, how likely each is, and how likely any other piece; ``size`` pieces in all.

    What is sent to the tasks is so 8 bytes for each distinct piece of each language's sample, which is bounded.
    """

    languages: list[str]
    prior: np.ndarray
    seen: list[tuple[np.ndarray, np.ndarray, float]]
    size: int

    def table(self, first: int = 0, many: int | None = None) -> np.ndarray:
        """Row p, column k: piece p in the k-th language from ``first`` on. The last row is for a character that the vocabulary lacks."""
        own = self.seen[first:] if many is None else self.seen[first : first + many]
        out = np.empty((self.size + 1, len(own)))
        for k, (piece, probability, other) in enumerate(own):
            out[:, k] = other
            out[piece, k] = probability
        out[-1] = UNKNOWN
        return out


def _by_length(distinct: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and characters of the words, those of one length together."""
    marked = [BEGIN + w for w in distinct]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    order = np.argsort(length, kind="stable")
    for n in np.unique(length).tolist():
        own = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
        many = max(1, TOGETHER // n)
        for at in range(0, len(own), many):
            some = own[at : at + many]
            text = "".join([marked[i] for i in some])
            yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n).astype(np.uint64)


class _Lattice:
    """All segmentations of some words of equal length. The last row of a table of probabilities is that of an unknown character."""

    def __init__(self, ids: list[np.ndarray]) -> None:
        self.ids, (self.size, self.length) = ids, ids[0].shape
        #: by begin: the lengths of the pieces that some word has there
        has = np.stack([np.pad((x >= 0).any(0), (0, self.length - x.shape[1])) for x in ids])
        has[0] = True
        self.steps = [np.flatnonzero(has[:, a]).tolist() for a in range(self.length)]

    def weight(self, p: np.ndarray, begin: int, k: int) -> np.ndarray:
        """The probabilities of the pieces of k + 1 characters; no piece has none, but for a single character that of the unknown."""
        found = self.ids[k][:, begin]
        w = p[found]
        if k:
            w[found < 0] = 0
        return w

    def forward(self, p: np.ndarray, keep: bool = False) -> tuple[list, list]:
        """Probability of every prefix, summed over all its segmentations, divided by e to the power of a second number.

        Unless they are to be kept, prefixes that nothing needs any more are dropped.
        """
        zero = np.zeros((self.size, p.shape[1]))
        alpha: list = [zero + 1, *[None] * self.length]
        scale = zero
        scales = [scale]
        for a in range(self.length):
            for k in self.steps[a]:
                part = alpha[a] * self.weight(p, a, k)
                alpha[a + k + 1] = part if alpha[a + k + 1] is None else alpha[a + k + 1] + part
            if a % SCALED == SCALED - 1:
                # what is still open is divided by the same number
                top = alpha[a + 1]
                for b in range(a + 1, min(self.length, a + len(self.ids)) + 1):
                    alpha[b] = alpha[b] / top if alpha[b] is not None else None
                scale = scale + np.log(top)
            scales.append(scale)
            if not keep:
                alpha[a] = None
        return alpha, scales

    def backward(self, p: np.ndarray) -> tuple[list, list]:
        """The same for every suffix, of the prefix that ends where it begins."""
        zero = np.zeros((self.size, p.shape[1]))
        beta: list = [None] * self.length + [zero + 1]
        scale = zero
        scales: list = [None] * self.length + [scale]
        for a in range(self.length - 1, -1, -1):
            # later suffixes may have been divided by less
            beta[a] = sum(self.weight(p, a, k) * beta[a + k + 1] * np.exp(scales[a + k + 1] - scale) for k in self.steps[a])
            if a % SCALED == 0:
                scale = scale + np.log(beta[a])
                beta[a] = zero + 1
            scales[a] = scale
        return beta, scales

    def expected(self, p: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
        """Expected occurrences of every piece (of the unknown: at ``size``), where the words occur so often. ``p`` has one column."""
        alpha, up = self.forward(p, keep=True)
        beta, down = self.backward(p)
        whole = np.log(alpha[-1]) + up[-1]
        total = np.zeros(size + 1)
        for a in range(self.length):
            for k in self.steps[a]:
                end = a + k + 1
                share = alpha[a] * self.weight(p, a, k) * beta[end] * np.exp(up[a] + down[end] - whole)
                found = self.ids[k][:, a]
                total += np.bincount(np.where(found < 0, size, found), share[:, 0] * often, minlength=size + 1)
        return total


def log_probabilities(distinct: list[str], vocabulary: Pieces, p: np.ndarray) -> np.ndarray:
    """Per word and language the logarithm of the sum over all segmentations."""
    out = np.zeros((len(distinct), p.shape[1]))
    for own, chars in _by_length(distinct):
        alpha, scales = _Lattice(vocabulary.ids(chars)).forward(p)
        out[own] = np.log(alpha[-1]) + scales[-1]
    return out


def fit(counts: Counter, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, float]:
    """A language's pieces from its words, by EPOCHS rounds of expectation-maximisation: those that occur, their probabilities, that of any other."""
    size = len(vocabulary.names)
    p = np.full((size + 1, 1), 1.0 / size)
    p[-1] = UNKNOWN
    distinct = sorted(counts)
    often = np.fromiter((counts[w] for w in distinct), float, len(distinct))
    expected = np.zeros(size + 1)
    for _ in range(EPOCHS):
        expected = np.zeros(size + 1)
        for at, chars in _by_length(distinct):
            expected += _Lattice(vocabulary.ids(chars)).expected(p[:, [0]], often[at], size)
        p[:size, 0] = (expected[:size] + SMOOTHING) / (expected[:size].sum() + SMOOTHING * size)
    found = np.flatnonzero(expected[:size])
    return found, p[found, 0], SMOOTHING / (expected[:size].sum() + SMOOTHING * size)


def train(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on up to ``rows`` documents that have a text and a language, each language in a task of its own, from counts of words.

    Languages may be as many as rows of the sample. Without such documents no language is learned.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sample = bounded_sample(known, rows, "doc_id", "text").select("text", "lang")

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 0):
            seen: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang, None] += 1  # the documents
                seen.update((lang, w) for w in words_of(text))
            rows = [(*key, n) for key, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    # the sample comes in one partition
    words = sample.repartition(8, F.xxhash64("text")).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fitted(table: pa.Table) -> pa.Table:
        words = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        n = words.pop(None)
        piece, probability, other = fit(Counter(words), _of(vocabulary))
        return pa.table({"lang": [table["lang"][0].as_py()], "n": [n], "piece": [piece.astype("<i4").tobytes()], "probability": [probability.astype("<f4").tobytes()], "other": [other]})

    # a row for each language of the sample
    got = words.groupBy("lang").applyInArrow(fitted, "lang string, n long, piece binary, probability binary, other double").collect()
    if not got:
        return Model([], np.zeros(0), [], 0)
    got.sort(key=lambda r: r["lang"])
    total = sum(r["n"] for r in got)
    seen = [(np.frombuffer(r["piece"], "<i4"), np.frombuffer(r["probability"], "<f4"), r["other"]) for r in got]
    return Model([r["lang"] for r in got], np.array([(r["n"] + 1) / (total + len(got)) for r in got]), seen, len(_of(vocabulary).names))


class _Scores:
    """The words that a task has scored with a model of a few languages; more are scored in blocks, which hold no more than a few need."""

    def __init__(self, model: Model, vocabulary: Pieces) -> None:
        self.model, self.vocabulary = model, vocabulary
        self.index: dict[str, int] = {}
        few = len(model.languages) <= LANGUAGES
        self.dense = model.table() if few and model.languages else None
        self.table = np.zeros((1024, len(model.languages))) if few else None

    def blocks(self, distinct: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The first language of each block, and the scores of the words in it."""
        if self.dense is not None:
            yield 0, self.of(distinct)
            return
        for first in range(0, len(self.model.languages), LANGUAGES):
            yield first, log_probabilities(distinct, self.vocabulary, self.model.table(first, LANGUAGES))

    def of(self, distinct: list[str]) -> np.ndarray:
        at = np.fromiter((self.index.get(w, -1) for w in distinct), np.int64, len(distinct))
        out = self.table[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            names = [distinct[i] for i in new]
            out[new] = log_probabilities(names, self.vocabulary, self.dense)
            if len(self.index) + len(names) > REMEMBERED:
                self.index.clear()
            for i, w in zip(new.tolist(), names, strict=True):
                if len(w) <= REMEMBERED_LENGTH and (n := len(self.index)) < REMEMBERED:
                    if n == len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.index[w] = n
                    self.table[n] = out[i]
        return out


def identify(docs: DataFrame, model: Model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the probability of that language among those learned) of every row.

    ``und`` with score 0 where a text is null or has no letters, or no language was learned. Of equally likely languages the
    first by name is taken. Null ids and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scores = _Scores(m, _of(vocabulary))
        # scores of a batch are a number for each document and language
        for batch in pieces(it, 1, BATCH_BYTES // (1 + len(m.languages) // 64), "pieces"):
            split = [words_of(t or "") for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            code, distinct = pd.factorize(np.array(list(chain.from_iterable(split)), object))
            names, best = ["und"] * len(split), np.zeros(len(split))
            if m.languages and len(distinct):
                doc = np.repeat(np.arange(len(split)), n)
                total = np.empty((len(split), len(m.languages)))
                for first, each in scores.blocks(list(distinct)):
                    for k in range(each.shape[1]):
                        total[:, first + k] = np.bincount(doc, each[code, k], minlength=len(split))
                total += np.log(m.prior)
                top = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(n):
                    names[i], best[i] = m.languages[top[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The rows whose languages are never learned."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predict(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Fit on the rows that aren't held out and identify every document: doc_id, held_out, lang_pred, score."""
    found = identify(docs, train(docs.where(~held_out()), vocabulary), vocabulary)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
