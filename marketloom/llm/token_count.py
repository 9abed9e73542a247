"""Token counts without token ids: pieces counted once per distinct pre-token, joined to per-document frequencies.

Each task turns a batch of documents into its distinct pre-tokens and, per document, how often each occurs. The distinct pre-tokens
go to buckets by hash; a bucket counts the pieces of each once, whichever and however many batches asked, and answers every
batch in the order in which it asked. The counts are then joined to the frequencies by batch and multiplied out.

How it scales: what moves is one entry per batch and distinct pre-token, so a word that is in every document weighs no more
than another. The number of buckets follows the bytes of all texts, so that each bucket has about the same number of entries. The
frequencies move once, as two or three bytes each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path
from .text_arrays import pieces, raw, remembered

BATCH_BYTES = 12 << 20
#: Bytes of text for each bucket of pre-tokens.
BUCKET_BYTES = 32 << 20
#: Pre-tokens of the vocabulary's own pattern, within a lower-cased word of letters and signs up to U+024F.
_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
#: Words that the library takes whole: other scripts, control characters, the dotted capital I, special tokens.
_WHOLE = re.compile(r"[\x00-\x1f\x7f-\xa0İɐ-\U0010ffff]|<\|")
#: Characters at which Python splits words and the vocabulary does not, and words by the vocabulary's own white space.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_UNSPLIT = re.compile(r"(?:\S|[\x1c-\x1f])+")
_tokenizers: dict = remembered("tokenizers")


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are on all cores already

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def pre_tokens(word: str) -> list[str]:
    """What a word without white space is split into; words of other scripts stay whole, to be split by the library."""
    if _WHOLE.search(word):
        return [word]
    word = word.lower()
    return [word] if word.isascii() and word.isalpha() else _PATTERN.findall(word)


def split_words(text: str) -> list[str]:
    """The words between the vocabulary's own white space."""
    return _UNSPLIT.findall(text) if _SEPARATORS.search(text) else text.split()


def _planes(a: np.ndarray) -> bytes:
    """The numbers' bytes by significance, so that the many zeros stand together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _numbers(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _frequencies(texts: list[str], buckets: int) -> tuple[dict[int, list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens by bucket; per document the number of its distinct ones, their codes (as steps), how often each occurs."""
    split = list(map(split_words, texts))
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    code, distinct = pd.factorize(np.array(list(chain.from_iterable(split)), object))
    parts = [pre_tokens(w) for w in distinct]
    n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
    part, names = pd.factorize(np.array(list(chain.from_iterable(parts)), object))
    bucket = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in names), np.int64, len(names))
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    asked: dict[int, list[str]] = {}
    for i in order.tolist():
        asked.setdefault(int(bucket[i]), []).append(names[i])
    first = np.cumsum(n_parts) - n_parts
    many = n_parts[code] if len(code) else np.zeros(0, np.int64)
    spot = np.repeat(first[code], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) if len(code) else np.zeros(0, np.int64)
    doc = np.repeat(np.repeat(np.arange(len(texts)), lengths), many)
    pair, often = np.unique(doc * max(1, len(names)) + rank[part[spot]], return_counts=True)
    doc, own = pair // max(1, len(names)), pair % max(1, len(names))
    steps = np.diff(own, prepend=0)
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    steps[new] = own[new]
    return asked, np.bincount(doc, minlength=len(texts)), steps, often


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, as the tokenizers library counts whole texts with this vocabulary.

    Null and empty texts have no bytes and no tokens. Null ids and repeated rows are kept, one result row each. An empty
    table gives no rows. Other columns are ignored. ``vocabulary`` must be of the kind of word_bpe_49k.json: lower case, white space dropped.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets or max(8, -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(pieces(it, 1, BATCH_BYTES, "tokenizers")):
            asked, n, steps, often = _frequencies([t or "" for t in batch.column(1).to_pylist()], buckets)
            row = {
                "batch": pa.array([(TaskContext.get().partitionId() << 32) + k]),
                "doc_id": pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                "n_bytes": pa.array([np.diff(raw(batch.column(1))[1]).tolist()], pa.list_(pa.int64())),
                "distinct": pa.array([_planes(n.astype("<u4"))], pa.binary()),
                "steps": pa.array([_planes(steps.astype("<u4"))], pa.binary()),
                "often": pa.array([_planes(often.astype("<u4"))], pa.binary()),
                "asked": pa.array([[{"bucket": b, "words": "\n".join(x)} for b, x in asked.items()]], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.string())]))),
            }
            yield pa.RecordBatch.from_arrays([*row.values()], [*row])

    def count(table: pa.Table) -> pa.Table:
        lists = [x.split("\n") for x in table["words"].to_pylist()]
        code, distinct = pd.factorize(np.array(list(chain.from_iterable(lists)), object))
        tokenizer, n = _tokenizer(vocabulary), []
        for at in range(0, len(distinct), 10_000):
            n += [len(e.ids) for e in tokenizer.encode_batch_fast(list(distinct[at : at + 10_000]), add_special_tokens=False)]
        found = np.array(n, "<u4")[code]
        ends = np.cumsum([len(x) for x in lists])
        answers = [_planes(x) for x in np.split(found, ends[:-1])]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})

    def multiply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            for k, r in enumerate(batch.select(["n_bytes", "distinct", "steps", "often", "answers"]).to_pylist()):
                each = [_numbers(a["answer"], "<u4") for a in sorted(r["answers"] or [], key=lambda a: a["bucket"])]
                n = _numbers(r["distinct"], "<u4").astype(np.int64)
                # codes begin anew with each document
                steps = _numbers(r["steps"], "<u4").astype(np.int64)
                total = np.cumsum(steps)
                first = np.cumsum(n) - n
                base = np.repeat(np.where(n > 0, total[np.minimum(first, max(0, len(total) - 1))] - steps[np.minimum(first, max(0, len(total) - 1))], 0), n) if len(total) else total
                weight = np.concatenate(each).astype(np.int64)[total - base] * _numbers(r["often"], "<u4") if len(total) else total
                sums = np.concatenate([[0], np.cumsum(weight)])
                own = ids[k].values
                yield pa.RecordBatch.from_arrays([own, pa.array(r["n_bytes"], pa.int64()), pa.array((sums[first + n] - sums[first]).astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    path = new_path(spark, "pre-tokens")
    schema = f"batch long, doc_id array<{kind}>, n_bytes array<long>, distinct binary, steps binary, often binary, asked array<struct<bucket: int, words: string>>"
    source.mapInArrow(gather, schema).write.option("compression", "zstd").parquet(path)
    batches = spark.read.parquet(path)
    asked = batches.select("batch", F.inline("asked"))
    answers = asked.groupBy("bucket").applyInArrow(count, "batch long, bucket int, answer binary")
    by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    joined = batches.drop("asked").join(by_batch, "batch", "left").select("doc_id", "n_bytes", "distinct", "steps", "often", "answers")
    return joined.mapInArrow(multiply, f"doc_id {kind}, n_bytes long, n_tokens long")
