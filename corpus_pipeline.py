"""From raw documents to packed token sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklore import session
from worklore.llm import host_quality, line_windows, ngram_join, packing
from worklore.llm.queries import WORD_BPE, table
from worklore.llm.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that mostly pass them."""
    ship(spark)
    return host_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the three-line passages that occurred before."""
    return line_windows.keep_fresh_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word sequences."""
    ship(spark)
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids, sequences and places there."""
    ship(spark)
    return packing.pack_documents(docs, WORD_BPE, 2048, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing_stage),
]

# Tokens and similarity components are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = session.stage(stage(spark, docs, sf_dir), name)
    return docs
