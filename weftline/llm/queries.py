"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chunks, fingerprints, licenses, lines, mixing, quality, sharding, simhash, topk
from weftline.sources.tables import table

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """WEFTLINE_TOKENIZER, or else the file of the installed public tokenizers."""
    if path := os.environ.get("WEFTLINE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), SHARD_BYTES)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_documents(spark, sf_dir))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("__kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_topk, op3_licenses, op4_substring_dedup, op5_bpe, op6_simhash, op7_fingerprints, op8_quality, op9_mixing, op10_line_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested by brute force."""
    return {"op1_sharding": sharding.sql(SHARD_BYTES), "op2_topk": topk.SQL, "op3_licenses": licenses.sql(), "op9_mixing": mixing.SQL}
