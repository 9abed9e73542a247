"""Token-id files: each document a zstandard frame of its own, with one shared dictionary and an index of offsets.

The format is a folder with two Parquet tables, so that any file system that Spark reads can hold it and a lost executor's
files are replaced by Spark's commit protocol:

* ``dictionary``: sha256, bytes. One row; trained on serialized id arrays. No bytes where there is too little to train on.
* ``blocks``: part, block, start (ids in the part before the block), dictionary (its sha256), first_id, last_id, doc_id[], n_tokens[], offset[],
  frames. Blocks are in ascending doc_id order by (part, block); document k of a block is ``frames[offset[k] : offset[k + 1]]``.

A frame holds the ids as little-endian unsigned integers of 2 bytes if all fit, else of 4; its first byte says which. A short
document is read by decompressing its own frame only; which blocks are read at all is decided by Parquet's statistics of first_id and last_id,
in row groups of a few blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import bounded_sample, new_path
from .text_arrays import pieces
from .token_ids import WordCoder

END_ID = 2
#: The dictionary is trained on parts of whole arrays: of so many documents, so many parts of so many bytes, both by the smallest hash. The
#: trainer needs about 100 times the dictionary's size and holds all of it in memory.
SAMPLE_DOCUMENTS, SAMPLE_PARTS, PART_BYTES, DICTIONARY_BYTES = 512, 2_048, 4_096, 65_536
BLOCK_BYTES, LEVEL = 4 << 20, 3
_BLOCKS = "part int, block int, start long, dictionary string, first_id {kind}, last_id {kind}, doc_id array<{kind}>, n_tokens array<long>, offset array<long>, frames binary"


def serialized(ids: bytes) -> bytes:
    """Little-endian 32-bit ids as the payload of a frame."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if not len(a) or a.max() < 65_536 else b"\x04" + ids


def deserialized(payload: bytes) -> bytes:
    """The payload of a frame as little-endian 32-bit ids."""
    return payload[1:] if payload[0] == 4 else np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes()


def _trained(docs: DataFrame, vocabulary: str) -> bytes:
    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.of(vocabulary)
        for batch in pieces(it, 0, 1 << 20, "coders"):
            arrays = [serialized(x) for x in coder.encode([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + PART_BYTES] for x in arrays for i in range(0, len(x), PART_BYTES)], pa.binary())], ["part"])

    # the sample comes in one partition
    some = bounded_sample(docs, SAMPLE_DOCUMENTS, "doc_id", "text").select("text").repartition(8, F.xxhash64("text"))
    samples = [bytes(r["part"]) for r in some.mapInArrow(parts, "part binary").orderBy(F.xxhash64("part")).limit(SAMPLE_PARTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, append ``end_id``, and write the folder ``path``.

    A null text is an empty one, whose only id is ``end_id``. Rows with equal ids are all written, in the order of a hash of
    their texts; a null id comes first. Repeated rows are spread like any others. Without documents the table of blocks is empty. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = _trained(source, vocabulary)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.range(1).select(F.lit(sha).alias("sha256"), F.lit(bytearray(dictionary)).alias("bytes")).coalesce(1).write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.of(vocabulary)
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compress = zstandard.ZstdCompressor(level=LEVEL, **shared).compress
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids_: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def flushed() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64).tolist()
            row = [[part], [block], [start], [sha], [ids_[0]], [ids_[-1]], [ids_], [counts], [offsets], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        size, schema = 0, None
        for batch in pieces(it, 1, 1 << 20, "coders"):
            id_ = batch.schema.field(0).type
            schema = schema or pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("dictionary", pa.string()), ("first_id", id_), ("last_id", id_), ("doc_id", pa.list_(id_)), ("n_tokens", pa.list_(pa.int64())), ("offset", pa.list_(pa.int64())), ("frames", pa.binary())])
            for i, ids in zip(batch.column(0).to_pylist(), coder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids_.append(i)
                counts.append(len(ids) // 4 + 1)
                frames.append(compress(serialized(ids + end)))
                size += len(frames[-1])
            if size >= BLOCK_BYTES:
                yield flushed()
                block, start, size = block + 1, start + sum(counts), 0
                ids_, counts, frames = [], [], []
        if frames:
            yield flushed()

    # hash and number keep rows of one id, or equal ones, from having to share a partition
    order = ["doc_id", "h", "row"]
    placed = source.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = placed.mapInArrow(encode, _BLOCKS.format(kind=kind.simpleString()))
    blocks.write.option("compression", "none").option("parquet.block.size", 2 * BLOCK_BYTES).parquet(f"{path}/blocks")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = _dictionary(spark, path)
    kind = blocks.schema["doc_id"].dataType.elementType

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                ids = list(_frames(r, shared))
                n = np.array([len(x) // 4 for x in ids], np.int64)
                columns = [pa.array(np.full(len(n), r["part"], np.int32)), pa.array(r["doc_id"], batch.schema.field("doc_id").type.value_type), pa.array(r["start"] + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(decode, f"part int, doc_id {kind.simpleString()}, inside long, n_tokens long, ids_crc32 long")
    # from the index alone; a row for each part, of which there are as many as write tasks
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row["bytes"])).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have the hash it is stored under")
    return bytes(row["bytes"])


def _frames(block: dict, dictionary: bytes, which: list[int] | None = None) -> Iterator[bytes]:
    if block["dictionary"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the block was written with another dictionary")
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decompress = zstandard.ZstdDecompressor(**shared).decompress
    for k in range(len(block["doc_id"])) if which is None else which:
        yield deserialized(decompress(block["frames"][block["offset"][k] : block["offset"][k + 1]]))


def read_documents(spark: SparkSession, path: str, ids: list) -> dict[object, list[list[int]]]:
    """The token ids of the documents with some ids, decompressing their frames only: for each id that is there a list of arrays.

    For a handful of lookups, not for scans: blocks are chosen by their first and last id, and what is found comes to the driver. Null ids
    can't be looked up.
    """
    dictionary, wanted = _dictionary(spark, path), sorted({i for i in ids if i is not None})
    out: dict[object, list[list[int]]] = {}
    if not wanted:
        return out
    # a block whose first id is null holds other ids behind it
    within = reduce(or_, ((F.col("first_id").isNull() | (F.col("first_id") <= i)) & (F.col("last_id") >= i) for i in wanted))
    for r in spark.read.parquet(f"{path}/blocks").where(within).toLocalIterator():
        which = [k for k, i in enumerate(r["doc_id"]) if i in wanted]
        for k, x in zip(which, _frames(r.asDict(), dictionary, which), strict=True):
            out.setdefault(r["doc_id"][k], []).append(np.frombuffer(x, "<u4").tolist())
    return out


def store(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the files into a new folder of the shared one and read them back."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, vocabulary, path, **options)
    return read_back(docs.sparkSession, path)
