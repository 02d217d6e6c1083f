"""A training corpus from the documents table: toxicity, exact and near duplicates, mixture, packing.

Every stage takes an empty table, nulls in any column, repeated rows and whole texts of any length, and hands on
all columns of ``documents``, further ones too. How each decides is stated below and in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlake.functions.shared import saved
from bidlake.llm import dedup, mixing, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents found toxic go. Null and empty texts show no evidence and stay; rows that repeat id and text fall alike."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the one with the smallest doc_id stays, once if its row repeats; null text counts as empty."""
    return dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of linked fingerprints the document with the smallest doc_id stays; texts without words link at fingerprint zero."""
    return simhash.simhash_dedup(docs)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents sampled to the tempered source, language and topic marginals; nulls are values of their own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every piece of every document with its token ids and its place in a sequence; an empty text is one end token."""
    return packing.pack(docs, memory=300_000)  # workers and executors hold memory of the stages before


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixture", sample_mixture),
    ("packing", pack_sequences),
]

#: SQL has no trained scorer, XXH64 or tokenizer; tests/llm/test_pipeline.py checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"corpus_{name}")
    return docs
