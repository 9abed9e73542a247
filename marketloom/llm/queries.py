"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, first_fit, html_text, jaccard, language, oracles, packing, prefix_trie, quality, sharding, token_count, token_store, toxicity, vector_codes
from .shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), n_shards=8)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), "v1")
    return entries.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (F.col("failure_bits").bitwiseAND(F.lit(quality.policy_mask("base"))) != 0).alias("base_failed"),
        "kept",
        "failure_bits",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.pack(first_fit.cut_documents(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_jaccard_join, op3_packing, op4_token_counts, op5_quality_rules, op6_token_store, op7_decontamination, op8_toxicity, op9_html_text, op10_language_id, op11_prefix_trie, op12_vector_codes, op13_first_fit)}

#: SQL of the queries that SQL can express.
ORACLE_SQL = oracles.SQL
