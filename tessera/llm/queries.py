"""The queries opN_<name> over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe as _bpe
from tessera.llm import flac as _flac
from tessera.llm import html as _html
from tessera.llm import language as _language
from tessera.llm import lm as _lm
from tessera.llm import merkle as _merkle
from tessera.llm import neardup as _neardup
from tessera.llm import packing as _packing
from tessera.llm import quality as _quality
from tessera.llm import toxicity as _toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return _quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return _language.language(table(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return _lm.scores(table(spark, folder, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _neardup.near_duplicates(table(spark, folder, "documents"), percent=85)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return _bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return _toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _flac.digest(_flac.store(table(spark, folder, "documents")))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return _html.extract(table(spark, folder, "pages"))


def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _merkle.fingerprints(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_language_id": op3_language_id,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_toxicity": op7_toxicity,
        "op8_media_columns": op8_media_columns,
        "op9_html_extraction": op9_html_extraction,
        "op10_document_fingerprints": op10_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    """None of these operators can be written in SQL alone; tests/llm compares them with brute force."""
    return {}
