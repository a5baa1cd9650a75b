"""A corpus pipeline: quality, lines, near-duplicates, mix and tokens, stage after stage.

Every stage takes a table of documents that may be empty, may hold nulls in any column, rows that repeat and columns of
its own, and gives back the columns it was given (the last one apart); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, lines, mixing, quality, simhash
from weftline.llm.queries import tokenizer_path
from weftline.session import Scratch
from weftline.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the documents given and the labels of the data folder.

    A null text is scored as an empty one, and rows of one text stay or go together.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat; documents left without any line go.

    The first line of a group stays where it is, by doc_id (null first). Null and blank texts have no lines and stay.
    """
    return lines.kept_documents(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id.

    Null and blank texts are one group. Rows without a doc_id stay, and so do rows that repeat the id and text of one that stays.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own, and null texts have no words."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document of the mix; null texts have no tokens."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder; each result is written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.save(out) if i + 1 < len(STAGES) else out
    return docs
