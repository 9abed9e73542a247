"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, neighbouring pairs and pairs with one word between, hashed to ``2**BITS`` places; a text has each or has it not.
Every coordinate has its own learning rate and an L1 penalty keeps most weights at exactly zero, so the model that is sent to the
tasks is a few thousand numbers (``2**BITS`` at most). Fitting sees a bounded, documented sample of labelled rows, which come to its one
task as places; scoring runs over all rows where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_sample
from .text_arrays import ALNUM, Words, mix, pieces, release, words

BITS = 20
#: Labelled rows that the model is fitted on, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 6
THRESHOLD = 0.3


@dataclass
class Model:
    """Places and values of the weights that aren't zero. An unfitted model gives 0."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.places] = self.weights
        return w


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every feature occurrence."""
    docs, hashes = [w.doc], [w.hash]
    for gap, odd in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        n = max(0, len(w.hash) - gap)
        at = np.flatnonzero(w.doc[:n] == w.doc[gap:])
        docs.append(w.doc[at])
        hashes.append(mix(w.hash[at] * np.uint64(odd) + w.hash[at + gap]))
    return np.concatenate(docs), (np.concatenate(hashes) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _distinct(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique((doc << BITS) | place)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def fit(places: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Model:
    """FTRL-proximal over examples in the given order, EPOCHS times; ``places[ends[i] : ends[i + 1]]`` are the distinct places of the i-th."""
    if not len(labels):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS  # a coordinate of its own, without penalty
    for _ in range(EPOCHS):
        for a, b, label in zip(ends[:-1].tolist(), ends[1:].tolist(), labels.tolist(), strict=True):
            at = np.append(places[a:b], bias)
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = _weights(z, n)
    found = np.flatnonzero(w[:-1])
    return Model(found, w[found], float(w[-1]), True)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that stand for the sums z and n; the last one is the bias."""
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on up to ``rows`` of the labelled documents. Rows without a label or text are not used."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    some = bounded_sample(known, rows, "doc_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    wanted = texts.join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id", "text").alias("place"), "text", "label")

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 1):
            doc, place = _distinct(*features(words(batch.column(1), ALNUM)))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["place", "features", "label"])

    # the limit is for repeated ids
    sample = wanted.mapInArrow(hashed, "place long, features array<int>, label int").orderBy("place").limit(rows)

    def fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [pa.RecordBatch.from_arrays(batch.columns[1:], ["features", "label"]) for batch in it]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        del batches
        lists = table["features"].combine_chunks()
        m = fit(lists.values.to_numpy(), lists.offsets.to_numpy(), table["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.places.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias])], ["places", "weights", "bias"])
        del table, lists
        release()

    got = sample.coalesce(1).mapInArrow(fitted, "places binary, weights binary, bias double").collect()
    if not got:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    return Model(np.frombuffer(got[0]["places"], np.int64), np.frombuffer(got[0]["weights"]), got[0]["bias"], True)


def _scores(texts: pa.Array, m: Model, w: np.ndarray) -> np.ndarray:
    doc, place = features(words(texts, ALNUM))
    some = np.flatnonzero(w[place])
    doc, place = _distinct(doc[some], place[some])
    margin = np.bincount(doc, w[place], minlength=len(texts)) + m.bias
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35))) if m.fitted else np.zeros(len(texts))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. A null text is an empty one, whose score is that of the bias alone.

    Null ids and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = sent.value, sent.value.dense()
        for batch in pieces(it, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), m, w))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold. Each is judged by its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = sent.value, sent.value.dense()
        for batch in pieces(it, at):
            yield batch.filter(pa.array(_scores(batch.column(at), m, w) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """The rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that aren't held out and score every document: doc_id, held_out, score, predicted."""
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
