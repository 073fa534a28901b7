"""Token counts from distinct pre-tokens.

A byte-pair tokenizer first splits a text into pre-tokens and then merges bytes
within each. The pieces of a pre-token are therefore counted once for each
distinct pre-token of the corpus; a document's tokens are the sum, over its
pre-tokens, of frequency times pieces. No ids are made.

Frequent pre-tokens have their pieces joined by a broadcast table of at most
``hot`` rows (their least frequency comes from a histogram), before anything is shuffled, so that a document sends on one
partial sum for all of them. Only frequencies of the others travel to meet
their pieces in an ordinary join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's pattern; in Java's syntax with Unicode classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HOT = 262_144


def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pretokens(text: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def _counter(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks, pattern)
        for batch in batches:
            counts = [len(own.encode_ordinary(w)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(counts, type=pa.int32())], names=["word", "n", "pieces"])

    return run


def piece_counts(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(word, n, pieces): each distinct pre-token, its occurrences, and the tokens it has."""
    words = docs.select(F.explode_outer(pretokens(F.col(text_col).cast("string"), pattern)).alias("word")).filter("word is not null")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.mapInArrow(_counter(ranks, pattern), "word string, n long, pieces int")


def _least(table: DataFrame, hot: int, steps: int = 64) -> float:
    """The smallest frequency, on a logarithmic grid, that at most ``hot`` pre-tokens reach."""
    place = F.floor(F.log2(F.col("n")) * steps)
    counts = {r.place: r["count"] for r in table.groupBy(place.alias("place")).count().collect()}
    # A step above the top one, which none reaches, for the case that even the commonest are too many.
    edge = max(counts, default=0) + 1
    for place in sorted(counts, reverse=True):
        hot -= counts[place]
        if hot < 0:
            break
        edge = place
    return 2 ** (edge / steps)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, hot: int = HOT) -> DataFrame:
    """(doc_id, pretokens, tokens), one row for each input row.

    A null or empty text has 0 of both. Rows are counted one by one: repeated
    rows, null ids and ids that several rows share each have their own count.
    Very long texts are counted whole. An empty table gives no rows. Other
    columns, whatever their names, are not looked at.
    """
    table = written(piece_counts(docs, text_col, ranks, pattern), "piece-counts")
    frequent = table.filter(F.col("n") >= _least(table, hot)).select("word", F.col("pieces").alias("known"))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumn("rid", F.monotonically_increasing_id())
    flat = src.select("rid", "doc_id", F.explode_outer(pretokens(F.col("t"), pattern)).alias("word"))
    met = flat.join(F.broadcast(frequent), "word", "left")
    rare = F.when(F.col("known").isNull(), F.col("word"))
    partial = written(
        met.groupBy("rid", "doc_id", rare.alias("word")).agg(F.count(F.coalesce("known", F.length("word"))).alias("times"), F.sum("known").alias("known")),
        "pretoken-frequencies",
    )
    joined = partial.filter("word is not null").join(table.select("word", "pieces"), "word").select("rid", "doc_id", "times", (F.col("times") * F.col("pieces")).alias("tokens"))
    rest = partial.filter("word is null").select("rid", "doc_id", "times", F.coalesce("known", F.lit(0)).alias("tokens"))
    return joined.unionByName(rest).groupBy("rid", "doc_id").agg(F.sum("times").alias("pretokens"), F.sum("tokens").alias("tokens")).drop("rid")
