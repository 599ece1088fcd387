"""The training-data pipeline over ``documents``: five stages, each over all that its predecessor kept.

All stages take null and empty texts (no words, kept unless the classifier rejects them or they are copies of each
other), null ids (never joined on), repeated rows and ties (one stays, by smallest id, then place), very long texts
(whole), empty tables (empty results) and extra columns of any name (carried to the last stage, which returns pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderbark.llm import decontaminate, exact_dedup, packing, quality, simhash
from cinderbark.llm.common import cut
from cinderbark.llm.queries import tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, 0.8)."""
    return simhash.keep_one_similar(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark items."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality_classifier", good),
    ("exact_dedup", first_copies),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", clean),
    ("packing", packed),
]

#: No stage but the second can be put into SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
