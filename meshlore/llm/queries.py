"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, exact_dedup, language, pitman_yor, quality, similarity, substring_dedup, toxicity, training_order
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fitted(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return language.identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_passages", "repeated_words", "kept_in")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of the shards that it writes, read back from them."""
    tokens = training_order.token_table(table(spark, sf_dir, "documents").select("text"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    path = f"{common.checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    training_order.write(tokens, path)
    return training_order.records(spark, path).select("shard", "slot", "byte_offset", (F.length("ids") / 2).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, digests=True).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, keep=["doc_id"]).select(
        "doc_id",
        (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.coalesce(F.aggregate(F.map_values("terms"), F.lit(0), lambda a, b: a + b), F.lit(0)).alias("n_terms"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity.jaccard_join(docs)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_training_order": op6_training_order,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": OP7_SQL,
}
