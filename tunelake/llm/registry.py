"""The queries of the corpus operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dialogs, licenses, lm, phrases, pieces, pii, quality, rules, sharding, simhash, toxicity, urls
from .common import table


def model_path() -> str:
    """The tokenizer model that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), model_path())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_all(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.report(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1,
        "op2_decontamination": op2,
        "op3_quality": op3,
        "op4_licenses": op4,
        "op5_simhash": op5,
        "op6_sentencepiece": op6,
        "op7_language_model": op7,
        "op8_sharding": op8,
        "op9_rules": op9,
        "op10_toxicity": op10,
        "op11_url_filters": op11,
        "op12_conversations": op12,
        "op13_phrases": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.ORACLE, "op2_decontamination": decontam.ORACLE, "op4_licenses": licenses.ORACLE, "op11_url_filters": urls.ORACLE, "op12_conversations": dialogs.ORACLE, "op13_phrases": phrases.ORACLE}
