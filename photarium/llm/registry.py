"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from photarium.llm import (
    bpe, clustering, decontamination, fill_middle, fingerprints, html, language, language_model, mixing, near_dedup,
    sharding, toxicity, urls,
)
from photarium.llm.common import read
from photarium.llm.oracles import ORACLES
from photarium.session import configure


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read(configure(spark), sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and its offending sentences."""
    docs = read(configure(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.digest(read(configure(spark), sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return language.identify(read(configure(spark), sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page address."""
    return urls.judge(read(configure(spark), sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "block_score"
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document."""
    return language_model.score(read(configure(spark), sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(configure(spark), sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.digest(read(configure(spark), sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_dedup.dedup(read(configure(spark), sf_dir, "documents")).drop("text_key")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    return decontamination.digest(read(configure(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest(read(configure(spark), sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and moved back."""
    return fill_middle.digest(read(configure(spark), sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding."""
    return clustering.digest(read(configure(spark), sf_dir, "embeddings"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_mixing, op2_toxicity, op3_fingerprints, op4_language, op5_url_filter, op6_language_model, op7_html,
        op8_sharding, op9_near_dedup, op10_decontamination, op11_bpe, op12_fill_middle, op13_clustering,
    )
}

__all__ = ["ORACLES", "QUERIES"]
