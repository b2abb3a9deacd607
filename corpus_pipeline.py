"""The corpus pipeline: documents through the operators of ``skycolumn.llm``, stage by stage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skycolumn.llm import mixing, near_dedup, perplexity, quality_rules, repack
from skycolumn.llm.common import table
from skycolumn.session import checkpoint_dir

# A trained language model, robust estimates and greedy packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted text of their language."""
    return perplexity.keep_fluent(docs, perplexity.trusted_of(table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %)."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 90 % of the entropy of equal weights; the budget passes every document at least once."""
    return mixing.mix(docs, budget=None, entropy=0.9)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return repack.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read back for the next one."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
