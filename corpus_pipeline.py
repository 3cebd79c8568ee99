"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of the
documents; the last adds the shard and the place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from photarium.llm import decontamination, mixing, near_dedup, sharding, toxicity
from photarium.llm.common import read, settle
from photarium.session import configure


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them does not find toxic."""
    return toxicity.clean(docs, toxicity.train(docs, read(configure(spark), sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.remove(docs, read(configure(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources by weight: each document as often as the mix takes it."""
    configure(spark)
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``, in shuffled order."""
    configure(spark)
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Toxicity rests on a trained model and the shards on a seeded shuffle, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
