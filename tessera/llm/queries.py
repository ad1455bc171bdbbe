"""Queries of the text operators over whole tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontaminate import decontaminate
from .jaccard import ngram_jaccard_join
from .main_text import main_text
from .mixing import mix_sources
from .pii import pii_surrogates
from .quality_model import quality_model
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .url_filter import RULES, url_filter
from .word_dedup import word_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules=RULES)


def op5_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup(table(spark, sf_dir, "documents"), window=50)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.7)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_ngram_jaccard_join, op2_main_text, op3_suffix_dedup, op4_url_filter, op5_word_dedup, op6_quality_model,
        op7_decontaminate, op8_pii_surrogates, op9_mix_sources, op10_quality_rules,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": oracles.JACCARD,
        "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op5_word_dedup": oracles.WORD_DEDUP,
        "op9_mix_sources": oracles.MIXING,
        "op10_quality_rules": oracles.QUALITY_RULES,
    }
