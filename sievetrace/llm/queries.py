"""Queries of this subpackage, one for each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievetrace.llm import byte_bpe, chat, jaccard, matroska, packing, quality, secrets, sharding, substring, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Query]:
    """Name to query."""
    return {
        "op1_url_filters": lambda s, d: url_filter.judge(s.read.parquet(f"{d}/pages.parquet")),
        "op2_ngram_jaccard_join": lambda s, d: jaccard.classes(_docs(s, d)),
        "op3_substring_dedup": lambda s, d: substring.digests(_docs(s, d)),
        "op4_media_columns": lambda s, d: matroska.digests(_docs(s, d)),
        "op5_quality_rules": lambda s, d: quality.measured(_docs(s, d)),
        "op6_sharding": lambda s, d: sharding.shards(_docs(s, d)),
        "op7_chat_formatting": lambda s, d: chat.rendered(s.read.parquet(f"{d}/conversations.parquet")),
        "op8_secret_scans": lambda s, d: secrets.findings(_docs(s, d)),
        "op9_packing": lambda s, d: packing.pieces(_docs(s, d)),
        "op10_byte_bpe": lambda s, d: byte_bpe.digests(_docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {
        "op1_url_filters": url_filter.oracle_sql(),
        "op2_ngram_jaccard_join": jaccard.oracle_sql(),
        "op3_substring_dedup": substring.oracle_sql(),
        "op5_quality_rules": quality.oracle_sql(),
        "op6_sharding": sharding.oracle_sql(),
        "op7_chat_formatting": chat.oracle_sql(),
    }
