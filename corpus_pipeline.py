"""Corpus pipeline: each stage calls one operator of the llm subpackage on all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, langid, packing, quality, substring
from tessera.llm.common import folder, stored_at
from tessera.session import deleted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; columns of documents."""
    return langid.identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; columns of documents."""
    return quality.passing(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; columns of documents."""
    return jaccard.without_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document or passage has; columns of documents."""
    return substring.remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: The language filter, the connected components and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; between stages the documents are written to the shared folder and read again.

    A stage's table goes when the next one is written; that of the last but one stays, for the result is read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = folder(spark, name)
            docs = stored_at(docs, path)
            if before:
                deleted(spark, before)
            before = path
    return docs
