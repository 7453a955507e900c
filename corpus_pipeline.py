"""The corpus pipeline: five stages over the documents, each by one of the operators in loamlake.llm.

A stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last one returns the pieces of packed sequences. n_chars is kept true to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import cut, table
from loamlake.llm.line_dedup import dedup_lines
from loamlake.llm.mixing import mix_sources
from loamlake.llm.ngram_join import keep_one_of_each
from loamlake.llm.packing import pack_documents
from loamlake.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from every text but the first; all documents stay."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, num=4, den=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share of as many rows as there are; repeated documents are repeated rows.

    Rows without a word go first: the quality rules let none in, so the line dedup emptied them as copies.
    """
    return mix_sources(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither zstandard nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL: str | None = None
