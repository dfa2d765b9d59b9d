"""The registered queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    collocations,
    decontamination,
    exact_dedup,
    jaccard_join,
    katz,
    language_id,
    license_scan,
    line_dedup,
    packing,
    quality,
    resampling,
    sharding,
)
from .tasks import read_table


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; the executors have it there too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontaminate(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op3_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz.katz_scores(read_table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(read_table(spark, folder, "documents"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_collocations(read_table(spark, folder, "documents"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_report(chat.with_hostile(read_table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_decontamination, op3_katz_backoff, op4_language_id, op5_jaccard_join, op6_exact_dedup, op7_sharding,
        op8_quality_classifier, op9_best_fit_packing, op10_line_dedup, op11_phrase_collocations, op12_importance_resampling,
        op13_chat_formatting)
}
SQL = {
    "op2_decontamination": decontamination.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_phrase_collocations": collocations.SQL,
    "op12_importance_resampling": resampling.SQL, "op13_chat_formatting": chat.SQL,
}
