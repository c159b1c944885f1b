"""The registered corpus queries: one per dealt operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binledger.llm import (
    codes, language, mixing, neardup, neighbours, packing, passages, periods, quality, secrets, toxicity, warc, wrappers,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_read(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=4)


def op4_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_read(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_read(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(_read(spark, sf_dir, "documents"), tailed=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


_QUERIES = (
    op1_language_id,
    op2_html_extraction,
    op3_minhash_near_dedup,
    op4_warc_capture_index,
    op5_nearest_neighbours,
    op6_mixing_sources,
    op7_secret_scans,
    op8_best_fit_packing,
    op9_substring_dedup,
    op10_quality_rules,
    op11_toxicity,
    op12_periodic_runs,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def statements() -> dict[str, str]:
    return {
        "op3_minhash_near_dedup": neardup.CHECK_SQL,
        "op4_warc_capture_index": warc.CHECK_SQL,
        "op6_mixing_sources": mixing.CHECK_SQL,
        "op12_periodic_runs": periods.CHECK_SQL,
        "op13_vector_codes": codes.CHECK_SQL,
    }
