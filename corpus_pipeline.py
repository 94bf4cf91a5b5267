"""The corpus pipeline: ``run(spark, sf_dir)`` takes ``documents`` through the stages in order.

Each stage's result is written as Parquet to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partsmith.llm import bpe, exact_dedup, mixing, simhash, toxicity
from partsmith.llm.common import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject."""
    return toxicity.survivors(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.survivors(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked as in op5_simhash, the one with the smallest doc_id stays."""
    return simhash.survivors(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of every document's tokens and of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", copies_out),
    ("SimHash near-dedup", near_copies_out),
    ("mixing", to_weights),
    ("byte-level BPE", encoded),
]

#: Compression distances, fingerprints and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
