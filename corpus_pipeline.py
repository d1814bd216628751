"""From raw documents to packed sequences. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm import mixing, near_dup, packing, quality, secrets


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard 0.8 or more."""
    return near_dup.keep_first(docs, width=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tempered source, language and topic shares are met, as many tokens as there are."""
    return mixing.sampled(docs, rate=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids with an end id, packed into windows of 2048: one row for each piece."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [
    ("quality_rules", good_quality),
    ("minhash_near_dup", drop_near_copies),
    ("secret_scans", without_secrets),
    ("mixing", to_target_mix),
    ("packing", packed),
]

#: Near-duplicate components, Markov models, raking and tokenizing have no SQL; tests/llm holds a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
