"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_dedup,
    html_text,
    licenses,
    line_crf,
    mixing,
    near_dedup,
    quality_rules,
    sentencepieces,
    token_counts,
    toxicity,
)
from ._common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"), 3, Fraction(85, 100))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(table(spark, sf_dir, "documents"), piece_model())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_mix_sources,
        op2_html_text,
        op3_quality_rules,
        op4_license_scan,
        op5_quality_crf,
        op6_minhash_near_dedup,
        op7_toxicity,
        op8_sentencepiece,
        op9_token_counts,
        op10_exact_dedup,
    )
    return {**{f.__name__: f for f in own}, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op6_minhash_near_dedup": near_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
