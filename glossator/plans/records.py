"""The table ``documents`` seen as annotated records, and predictions derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.functions.text import IDENTIFIER, matches
from glossator.operators.spans import annotation
from glossator.schema import ANNOTATIONS, CUE_LINKS, RECORD_VERSION


def entity_type(value):
    """The kind of identifier that a match is."""
    return F.when(value.contains("@"), "EMAIL").when(value.rlike(r"^\("), "PHONE").when(value.rlike("^[0-9]"), "NUMBER_GROUP").otherwise("CODE")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents; identifiers are annotated but in each fifth document, so that some occur unannotated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = F.transform(matches("text", IDENTIFIER), lambda m: annotation(entity_type(m["text"]), m["start"], m["end"], m["text"], F.col("text")))
    part = F.col("doc_id") % 10
    with_spans = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("case_id"), "doc_id", F.when(part < 6, "train").when(part < 8, "eval").otherwise("holdout").alias("split"), F.col("source").alias("family"),
        F.concat_ws(":", "lang", "source").alias("template_id"), "text", F.when(F.col("doc_id") % 5 != 0, spans).otherwise(F.array().cast(ANNOTATIONS)).alias("annotations"), "lang",
    )
    return with_spans.select(
        "case_id", "split", "family", F.concat_ws("/", F.lit("glossator"), "split", "family", F.col("doc_id")).alias("namespace"), "template_id",
        F.when(F.size("annotations") > 0, "positive").otherwise("unannotated").alias("kind"), F.lit("external").alias("provenance"), "text", "annotations",
        F.array().cast(CUE_LINKS).alias("cue_links"), *(F.lit(None).cast("string").alias(c) for c in ("persona", "organization", "cue_surface", "hard_negative_kind")),
        F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(RECORD_VERSION).alias("schema_version"), "doc_id", "lang",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted spans made from the annotations by rules on the id: some lost, some moved, some of another label, some invented, some for unknown ids."""
    rec = records(spark, sf_dir)
    k = F.col("doc_id") % 7
    moved = F.transform("annotations", lambda a: F.struct((a["start"] + (k == 1).cast("int")).alias("start"), a["end"].alias("end"), F.when(k == 2, "CODE").otherwise(a["entity_type"]).alias("entity_type")))
    invented = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("CODE").alias("entity_type")))
    none = F.array().cast("array<struct<start: int, end: int, entity_type: string>>")
    spans = F.when((k == 3) & (F.col("doc_id") % 4 == 0), invented).when(k == 4, none).otherwise(moved)
    case = F.when(F.col("doc_id") % 50 == 13, F.concat(F.lit("gone-"), F.col("doc_id"))).otherwise(F.col("case_id"))
    return rec.filter(F.col("doc_id") % 11 != 5).select(case.alias("id"), spans.alias("spans"))
