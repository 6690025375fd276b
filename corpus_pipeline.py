"""The training-data pipeline: five stages over `documents`, each on all that the one before it kept.

A stage is (spark, docs, sf_dir) -> DataFrame. Between stages the rows are written as Parquet and read again. All but
the last return the columns of documents; the last returns where each piece of each document is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kelpforge.llm import decontaminate, exact_dedup, language_id, packing, simhash
from kelpforge.llm._common import ensure_checkpoint_dir, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that has a good share of the words, go."""
    return language_id.keep_identified(docs)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 in five-word shingles the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names or units, go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_exact_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("best_fit_packing", pack_bins),
]

#: Mixture inference and near-copy components are iterative, and packing is sequential; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
