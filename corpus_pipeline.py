"""The corpus pipeline: documents to sharded training rows, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``. Stages learn and count from their own input only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellgrid.llm import language, mixing, nearcopies, sharding, winnowing
from wellgrid.llm.registry import table
from wellgrid.plans.durable import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or whose language is not sure."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (five-word shingles, Jaccard 0.8 or more).

    SimHash fingerprints propose pairs first and min-wise hashes those that are further apart; exact similarity decides.
    """
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words is benchmark text."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows."""
    return mixing.take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

ORACLE_SQL = None  # language scores and XXH64 fingerprints are not SQL; tests/llm/test_pipeline.py follows the stages in plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's table is kept as Parquet in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
