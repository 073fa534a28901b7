"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks of bytes. The distinct blocks, sorted
within their hash partition, receive integer names; adjacent names are then
paired and the distinct pairs named the same way, level by level, until a
document is left with one name. Two documents have the same (level, name)
exactly when their bytes are equal: a name stands for one block or one pair,
so there is nothing that could collide.

Documents refer to blocks of level 0 by a 128-bit digest, so that only the
distinct blocks travel; the digest is checked to be one-to-one on the blocks
themselves, and another seed is taken if it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_rows, written

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    raw = text.cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _digest(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for distinct rows: the position in the sorted order of their partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, text_hash, level, name) for each row; level and name are null for a null text."""
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    seed = 0
    while True:
        blocks = src.filter("t is not null").select(F.explode_outer(_blocks(F.col("t"), block_bytes)).alias("block"))
        k1, k2 = _digest(F.col("block"), seed)
        names = _named(blocks.distinct(), ["block"])
        dictionary = written(names.select(k1.alias("k1"), k2.alias("k2"), "name"), "block-names")
        total = dictionary.agg(F.count("*").alias("n"), F.count_distinct("k1", "k2").alias("d")).first()
        if total.n == total.d:
            break
        forget(dictionary)
        seed += 1

    def refs(t: Column) -> Column:
        return F.transform(_blocks(t, block_bytes), lambda b: F.struct(_digest(b, seed)[0].alias("k1"), _digest(b, seed)[1].alias("k2")))

    rows = written(
        src.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("t").alias("text_hash"),
            F.when(F.col("t").isNotNull(), refs(F.col("t"))).alias("refs"),
        ),
        "block-refs",
    )
    flat = rows.select("rid", F.posexplode("refs").alias("pos", "ref")).select("rid", "pos", "ref.k1", "ref.k2")
    current = written(flat.join(dictionary, ["k1", "k2"]).select("rid", F.col("pos").cast("long").alias("pos"), "name"), "names-0")
    longest = rows.agg(F.max(F.size("refs"))).first()[0] or 0
    sizes = rows.select("rid", F.size("refs").alias("blocks"))
    done, level = [], 0
    while longest > 1:
        # Documents of 2**level blocks or fewer have one name by now.
        step = current.join(sizes, "rid")
        done.append(step.filter(F.col("blocks") <= 2**level).filter(F.col("blocks") > (0 if level == 0 else 2 ** (level - 1))).select("rid", F.lit(level).alias("level"), "name"))
        pairs = (
            step.filter(F.col("blocks") > 2**level)
            .groupBy("rid", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = written(pairs, f"pairs-{level + 1}")
        level += 1
        current = written(pairs.join(_named(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"]).select("rid", "pos", "name"), f"names-{level}")
        forget(pairs)
        longest = (longest + 1) // 2
    last = current if level else current.join(sizes.filter("blocks >= 1"), "rid")
    found = last.select("rid", F.lit(level).alias("level"), "name")
    for part in done:
        found = found.unionByName(part)
    return rows.select("rid", "doc_id", "text_hash").join(found, "rid", "left")


def _decided(ids: DataFrame) -> DataFrame:
    known = ids.filter("name is not null")
    first = known.groupBy("level", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    same = known.join(first, ["level", "name"]).select(
        "rid", "doc_id", "text_hash", F.col("first.doc_id").alias("kept_id"), (F.col("rid") != F.col("first.rid")).alias("is_copy")
    )
    alone = ids.filter("name is null").select("rid", "doc_id", "text_hash", F.col("doc_id").alias("kept_id"), F.lit(False).alias("is_copy"))
    return same.unionByName(alone)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, kept_id, is_copy), one row for each input row.

    ``kept_id`` is the smallest id among the rows with the same bytes, and
    ``is_copy`` is true for all of them but one: of several rows with that
    smallest id the first read stays. An empty text is a text like any other.
    A null text equals nothing: its row is kept. A null id counts as larger
    than every id. Very long texts only add levels. An empty table gives no
    rows. Other columns, whatever their names, are not looked at.
    """
    return _decided(identities(docs, id_col, text_col, block_bytes)).select("doc_id", "kept_id", "is_copy")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row for each distinct text, all columns kept (see :func:`exact_duplicates`).

    Rows with a null text stay, one for each id.
    """
    kept = _decided(identities(docs, id_col, text_col, block_bytes)).filter("not is_copy")
    return keep_rows(docs, kept.select("doc_id", "text_hash").distinct(), id_col, text_col)


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, text,
         first_value(doc_id) OVER w AS first_id,
         row_number() OVER w AS rn
  FROM documents
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE first_id END AS kept_id,
       text IS NOT NULL AND rn > 1 AS is_copy
FROM d
"""
