"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage reads what the stage before kept; all but the last return the columns of documents.  A stage's rows are written
as Parquet to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialise, table
from tidemark.llm.decontam import drop_leaking
from tidemark.llm.jaccard import keep_one_per_group
from tidemark.llm.packing import default_tokenizer, pack_documents
from tidemark.llm.suffixdedup import cut_repeated_passages
from tidemark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.5 or more go."""
    return reject_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8) stays."""
    return keep_one_per_group(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose passages that occur elsewhere too."""
    return cut_repeated_passages(spark, docs, sf_dir)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaking(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, with their token ids, in windows of 4096."""
    return pack_documents(docs, default_tokenizer(), with_ids=True, cache=150_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Suffix sorting and alignment are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
