"""Small helpers of the operators; intermediate tables are those of ``glossator.sources.intermediate``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.sources.intermediate import forget, settled  # noqa: F401
from glossator.sources.intermediate import stored as written  # noqa: F401


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array without any."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is in ``kept(doc_id, text_hash)``, one row for each.

    ``kept`` has each pair once. Repeated rows collapse to one. Columns of
    ``docs`` come back unchanged, whatever their names.
    """
    names = docs.columns
    private = [f"__c{i}" for i in range(len(names))]
    at = {name: private[i] for i, name in enumerate(names)}
    inner = docs.toDF(*private).withColumn("__h", F.xxhash64(F.col(at[text_col]).cast("string")))
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__kh"))
    joined = inner.join(kept, inner[at[id_col]].eqNullSafe(kept["__id"]) & inner["__h"].eqNullSafe(kept["__kh"]))
    return joined.dropDuplicates(["__id", "__kh"]).select(*private).toDF(*names)
