"""A corpus pipeline: quality rules, near-duplicate removal, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratopoint.llm import common, minhash, mixing, quality, sentencepiece_codec, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without the lines that fail."""
    common.prepare(spark)
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    common.prepare(spark)
    return minhash.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too are cut out."""
    common.prepare(spark)
    return substring.without_repeats(docs, substring.Repeats(window=50, with_text=True))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice, in permuted blocks."""
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as SentencePiece ids."""
    common.prepare(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mixture),
    ("sentencepiece", piece_ids),
]

#: Best-score pieces are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
