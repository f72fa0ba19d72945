"""The registered queries of the corpus operators, over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import alignment, chat, decontam, html_crf, kneser_ney, ledger, licenses, line_dedup, merkle, mixing, progressive_jpeg, simhash, superminhash
from mnemospark.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.digest(ledger.scan(read(spark, sf_dir, "documents"))[0])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.digests(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("matches")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, read(spark, sf_dir, "conversations")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(read(spark, sf_dir, "documents"), rate=0.1, min_words=5)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(read(spark, sf_dir, "documents"))


def op13_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_simhash_near_dedup, op3_html_extraction, op4_source_mixing, op5_quality_classifier,
        op6_secret_scan, op7_media_columns, op8_license_scan, op9_chat_format, op10_line_dedup,
        op11_token_alignment, op12_merkle_manifest, op13_superminhash_near_dedup,
    )
}

SQL: dict[str, str] = {"op4_source_mixing": mixing.MIX_SQL, "op6_secret_scan": ledger.SECRETS_SQL, "op9_chat_format": chat.CHAT_SQL, "op12_merkle_manifest": merkle.MERKLE_SQL}
