"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, grading, licences, lm, ngram_join, pii, quality, substring
from .common import documents


def public_path(name: str) -> str:
    """Where a public tokenizer's file is; the vocabularies stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the surrogates in the registered query; a deployment brings its own.
PII_KEY = b"quire public example key"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality_rules(docs, quality.fit_quality(docs, labels(spark, sf_dir)))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir), PII_KEY)


def op6_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grading.grade(docs, grading.fit_grades(docs, labels(spark, sf_dir)))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_path("byte_bpe_multi_50k.tiktoken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), public_path("byte_bpe_50k.json"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir), 3, 90)


def queries() -> dict:
    own = (op1_quality_rules, op2_licence_scan, op3_lm_scoring, op4_decontamination, op5_pii_surrogates, op6_quality_grades, op7_bpe_encode_decode, op8_substring_dedup, op9_token_counts, op10_ngram_jaccard_join)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_licence_scan": licences.oracle(), "op4_decontamination": decontaminate.oracle(), "op10_ngram_jaccard_join": ngram_join.oracle()}
