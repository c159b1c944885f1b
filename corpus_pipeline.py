"""From raw documents to training sequences: five stages over the whole corpus.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns a
DataFrame; between stages the rows are written as Parquet in the shared folder and read again, so a
stage can be repeated by itself and no stage's plan contains another's. All but the last
return the columns of ``documents``.

Nulls and repeats follow the operators: a null or empty text fails the quality rules; rows without doc_id are
linked with nothing and stay; repeated rows are near-duplicates of each other only under different doc_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binledger.llm import mixing, neardup, packing, quality, secrets
from binledger.session import cut

#: Near-duplicates: word shingles of this length, similar from 0.8 on.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model, unchanged."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, unchanged."""
    return neardup.keep_first(docs, SHINGLE_WORDS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut at its budget's last word."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The model's verdicts, masks and token ids are beyond SQL; tests compare stage by stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
