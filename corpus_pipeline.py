"""A training-data pipeline: each stage reads what its predecessor kept and decides on all of it.

What the stages do with odd rows follows from their operators. A document with
a null or empty text has no language, so the first stage rejects it. A null id
is a document like any other in all stages but the third, which compares none
without an id and keeps it. Repeated rows become one in the second stage. Texts
are read whole, however long. Of documents that tie, the one with the smallest
id stays. Columns besides ``doc_id``, ``text``, ``lang`` and ``source``, whatever
their names, are passed on unchanged. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossator.llm import exact_dedup, language_id, mixing, pieces, simhash_dedup
from glossator.llm.common import forget, settled


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; those that it rejects go, null and empty texts among them."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the smallest id; a null text equals nothing."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, the one with the smallest id; documents without an id or a word stay."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target shares of the tokens; a null source is a source."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, which the piece ids give back, with the n best segmentations and whether decoding was exact."""
    return pieces.encoded(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: SQL can express neither the network nor the piece lattice; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again by the next.

    Tables that a stage stores on its way are deleted when its result is
    written, and that when the next one's is: only the last result stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = settled(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023
        forget(docs)
        docs = kept
    return docs
