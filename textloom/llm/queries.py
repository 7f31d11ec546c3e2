"""The registered queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.session import ship_package

from . import bpe_duckdb, chat_format, decontaminate, drake_clusters, flac_media, line_dedup, ordinal_quality, pu_toxicity, simhash_mih, token_files, url_reputation, warc_zstd, whitening
from .shared import read_table

#: Where the vocabularies are; the environment may name another folder.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS") or os.path.dirname(public_tokenizers.path("README.md"))


def vocabulary(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(spark, read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), url_reputation.page_outcomes(labels))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive_report(spark, read_table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.coding_report(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.media_report(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(spark, chat_format.with_control_strings(read_table(spark, sf_dir, "conversations")))


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake_clusters.cluster_report(read_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(read_table(spark, sf_dir, "embeddings"))


def op13_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_token_files, op2_line_dedup, op3_url_reputation, op4_warc_zstd, op5_simhash_near_dedup,
        op6_ordinal_quality, op7_decontamination, op8_bpe_duckdb, op9_flac_media, op10_chat_format,
        op11_drake_clusters, op12_whitening, op13_pu_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_url_reputation": url_reputation.oracle(),
    "op4_warc_zstd": warc_zstd.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_drake_clusters": drake_clusters.oracle(),
}
