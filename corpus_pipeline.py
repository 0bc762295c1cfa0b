"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from tidemark.llm.base import written
from tidemark.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from the labels of those it may see.

    Each row is judged by its text; null and empty ones score the machine's bias. Labels of other documents,
    null or contradictory labels do not count. An empty table gives no rows.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id, and of rows that repeat both one.

    Null texts are empty ones; a null id stays only where its text has no other. An empty table gives no rows.
    """
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id; texts without words are no duplicates.

    Rows that share an id stay or go together; rows without an id stay. An empty table gives no rows.
    """
    return exact_dedup.keep_rows(docs, near_dedup.dedup(docs))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that documents with smaller ids have already.

    Null and short texts, and rows without an id, stay as they are. An empty table gives no rows.
    """
    return substring_dedup.remove(docs, substring_dedup.passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, alike documents side by side.

    Null and empty texts are the closing id alone; each row is packed for itself. An empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack_sequences),
]

#: Scores, samples, chains and curves have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
