"""A training-corpus pipeline: quality, near-duplicates, personal data, mixing and packing.

Each stage is one operator of tessera.llm with its production parameters. It takes (spark, docs, sf_dir), works on all
that the stage before kept, and returns the columns of documents (the last: the packed pieces). Between stages the rows
are written to the shared folder as Parquet and read again, so a stage that fails is rerun from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, pii, simhash, weak_quality
from tessera.llm.common import store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model does not reject."""
    return weak_quality.keep_good(docs, weak_quality.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms replaced; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights are raked to the tempered shares of source, language and topic."""
    return mixing.sample(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage{k}")
    return docs


#: Stages hash shingles with XXH64, fit models and tokenise, which SQL cannot express; tests hold each against brute force.
ORACLE_SQL = None
