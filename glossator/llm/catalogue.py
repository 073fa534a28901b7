"""Queries of the operators over their whole tables, and SQL where it can express them.

Operators that store tables on their way are settled: the result is written,
and only it stays in the shared folder (``intermediate.clean`` deletes that too).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, exact_dedup, language_id, license_scan, mixing, pieces, simhash_dedup, token_counts, url_filter
from .common import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@_query("op1_exact_dedup", exact_dedup.EXACT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "exact-duplicates", lambda: exact_dedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@_query("op3_simhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "near-duplicates", lambda: simhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@_query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.identified(docs, language_id.fit(docs)).drop("text_hash")


@_query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "mixing-rates", lambda: mixing.rates(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@_query("op7_piece_encoding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "token-totals", lambda: token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@_query("op5_chat_formatting", chat.CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat_refs(chat.format_chats(chat.parts_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


@_query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "neighbours", lambda: ann.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


@_query("op8_license_scan", license_scan.LICENSE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"), wrapped=True)


@_query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "url-verdicts", lambda: url_filter.filter_urls(url_filter.seeded(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
