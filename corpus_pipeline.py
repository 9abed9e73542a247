"""Prepare a training corpus from ``documents``: five stages, each one operator of marketloom.llm over all its predecessor kept.

Every stage is called with (spark, docs, sf_dir); what it returns is written as Parquet and read again as the docs of the next.
All but the last return the columns of ``documents``. Rows are filtered where they are, with their columns carried along, so that
texts are not moved to be joined with a verdict; the near-duplicate stage joins the keys that go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontamination, jaccard, packing, quality, toxicity
from marketloom.llm.queries import vocabulary_path
from marketloom.llm.scratch import discard, written
from marketloom.llm.shipping import ship

#: Up to so many ids of documents that go are sent to all tasks (40 MB at most); beyond, they are joined by a shuffle.
SENT_IDS = 500_000

#: Words whose ids a worker remembers while it packs: workers have the memory of the stages before.
REMEMBERED = 250_000

#: The rows of run() can't be had from SQL: learned weights and a tokenizer decide them.
ORACLE_SQL = None


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as the id of its text, so that an operator carries it along."""
    return docs.select(F.struct(*docs.columns).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go. Without labels none go.

    Null and empty texts have a score too and stay unless the model says otherwise. Each of repeated rows, and rows without an id, is judged
    by its text. An empty table gives an empty one. Columns of any name are carried along unchanged.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = toxicity.held_out()
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.drop_toxic(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v1 go; null and empty texts are among them.

    Each of repeated rows, and rows without an id, is judged by its text. An empty table gives an empty one. Columns of any name are
    carried along unchanged.
    """
    return quality.apply_policy(quality.ledger(_whole_rows(docs)), "v1").where("kept").select("doc_id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, that with the smallest id; one without an id only where none has one.

    A row is named by its id and its text, so rows that share an id but not their text are documents of their own, with or without an id. Of
    repeated rows one stays. Rows without words, null and empty texts among them, are near duplicates of nothing and all stay. An empty
    table gives an empty one. Columns of any name are carried along unchanged.
    """
    ship(spark)
    # sorted by id, null ids last; rows of one key are copies of each other
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("x"), F.hash("text").alias("y"))
    found = written(jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text")), "components")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("key")).distinct()
    repeated = found.where("doc_id = component_id AND n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    gone, repeated = (written(keys, "keys") for keys in (gone, repeated))
    discard(found)
    sent = lambda keys: F.broadcast(keys) if keys.count() <= SENT_IDS else keys
    # the row is one value, so that no column of its own is named as a key
    stays = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).join(sent(gone), "key", "left_anti")
    if not repeated.take(1):
        return stays.select("row.*")
    repeated = sent(repeated)
    once = stays.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return stays.join(repeated, "key", "left_anti").select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Without items none go.

    Null and empty texts have no words and stay. Each of repeated rows, and rows without an id, is judged by its text. An empty table gives
    an empty one. Columns of any name are carried along unchanged.
    """
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is cut and packed into sequences of 1,024 tokens: a row for each piece.

    A null or empty text is its end id alone. Repeated rows and rows without an id are packed like any others. An empty table gives no
    rows. Of other columns none is read.
    """
    ship(spark)
    return packing.pack(packing.cut_documents(docs, vocabulary_path("byte_bpe_50k.json"), remembered=REMEMBERED))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
