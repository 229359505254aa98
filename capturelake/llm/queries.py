"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import chat, codes, decontaminate, languages, licenses, lines, media, packing, periods, secrets, similar, substrings, suffixes
from capturelake.llm.text import read


def op1_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.repeats(read(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(licenses.scan_licenses(read(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.repeats(read(spark, sf_dir, "documents")))


def op8_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.class_digests(read(spark, sf_dir, "documents"))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(read(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(lines.dedup_lines(read(spark, sf_dir, "documents")))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read(spark, sf_dir, "documents")).drop("proportions")


def op11_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.find_runs(periods.planted(read(spark, sf_dir, "documents"))))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[native]"""
    return chat.chat_digests(chat.read_chats(chat.format_chats(chat.with_probe(read(spark, sf_dir, "conversations")))))


def op13_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digests(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_groups, op2_licenses, op3_line_windows, op4_spaced_seeds, op5_secrets, op6_language_mixture, op7_block_anchors, op8_token_groups, op9_transport_streams,
        op10_best_fit_packing, op11_diagonal_runs, op12_chat_format, op13_norm_of_sum_codes,
    )
}
ORACLES = {"op3_line_windows": lines.ORACLE, "op12_chat_format": chat.ORACLE, "op13_norm_of_sum_codes": codes.ORACLE}
