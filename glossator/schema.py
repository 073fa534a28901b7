"""Record model: one row for each annotated text."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

RECORD_VERSION = "glossator.record/v1"
MANIFEST_VERSION = "glossator.manifest/v1"
IMPORT_VERSION = "glossator.import/v1"
SPLITS = ("train", "eval", "holdout")
KINDS = ("positive", "hard_negative", "unannotated")

ANNOTATION = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("byte_start", IntegerType()),
        StructField("byte_end", IntegerType()),
        StructField("text", StringType()),
    ]
)
CUE_LINK = StructType([StructField("cue", StringType()), StructField("entity_type", StringType())])
RECORD = StructType(
    [
        StructField("case_id", StringType()),
        StructField("split", StringType()),
        StructField("family", StringType()),
        StructField("namespace", StringType()),
        StructField("template_id", StringType()),
        StructField("kind", StringType()),
        StructField("provenance", StringType()),
        StructField("text", StringType()),
        StructField("annotations", ArrayType(ANNOTATION)),
        StructField("cue_links", ArrayType(CUE_LINK)),
        StructField("persona", StringType()),
        StructField("organization", StringType()),
        StructField("cue_surface", StringType()),
        StructField("hard_negative_kind", StringType()),
        StructField("metadata", MapType(StringType(), StringType())),
        StructField("schema_version", StringType()),
    ]
)
SPAN = "struct<start: int, end: int, entity_type: string>"
ANNOTATIONS = f"array<{ANNOTATION.simpleString()}>"
CUE_LINKS = f"array<{CUE_LINK.simpleString()}>"
