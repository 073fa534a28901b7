"""Sinks: records as JSON lines, and span and token formats of other tools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.operators.spans import tagged

FORMATS = ("jsonl", "bio", "huggingface", "spacy", "presidio")


def canonical(value) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def pretty(value) -> str:
    """Indented JSON with sorted keys, ended by a newline."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def record_json(records: DataFrame, *keep: str) -> DataFrame:
    """(split, kept columns, value): each record as JSON with its keys in alphabetical order, nulls kept."""
    fields = sorted(c for c in records.columns)
    # A map has no order of its own.
    even = records.withColumn("metadata", F.map_from_entries(F.array_sort(F.map_entries("metadata")))) if "metadata" in fields else records
    return even.select("split", *keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def _tokens(records: DataFrame) -> DataFrame:
    rows = tagged(records)
    good = F.when(F.col("tag").isNotNull(), F.col("tag")).otherwise(F.raise_error(F.concat(F.lit("an entity cuts through a token of "), F.col("case_id"))))
    return rows.groupBy("case_id", "split").agg(F.sort_array(F.collect_list(F.struct("pos", "token", good.alias("tag"), "start", "end"))).alias("t"))


def lines(records: DataFrame, kind: str) -> DataFrame:
    """(split, value): the records in a format; a value is a line, in ``bio`` a block of lines."""
    if kind == "jsonl":
        return record_json(records)
    if kind == "bio":
        body = F.array_join(F.transform("t", lambda x: F.concat_ws("\t", x["token"], x["tag"])), "\n")
        return _tokens(records).select("split", F.concat(F.lit("# id="), "case_id", F.lit(" split="), "split", F.lit("\n"), body, F.lit("\n")).alias("value"))
    if kind == "huggingface":
        own = records.select("case_id", "split", "text", "annotations").join(_tokens(records), ["case_id", "split"])
        spans = F.transform("annotations", lambda a: F.struct(a["end"].alias("end"), a["entity_type"].alias("entity_type"), a["start"].alias("start"), a["text"].alias("text")))
        row = F.struct(
            F.col("case_id").alias("id"), F.transform("t", lambda x: x["tag"]).alias("ner_tags"), spans.alias("spans"), "split", "text",
            F.transform("t", lambda x: F.array(x["start"], x["end"])).alias("token_offsets"), F.transform("t", lambda x: x["token"]).alias("tokens"),
        )
        return own.select("split", F.to_json(row).alias("value"))
    if kind == "spacy":
        # An entity is a list of two numbers and a string, which no array type holds, so it is written out.
        each = F.transform("annotations", lambda a: F.concat(F.lit("["), a["start"], F.lit(","), a["end"], F.lit(',"'), a["entity_type"], F.lit('"]')))
        rest = F.substring(F.to_json(F.struct(F.col("case_id").alias("id"), "split", "text")), F.lit(2), F.lit(2**31 - 1))
        return records.select("split", F.concat(F.lit('{"entities":['), F.array_join(each, ","), F.lit("],"), rest).alias("value"))
    if kind == "presidio":
        spans = F.transform("annotations", lambda a: F.struct(a["end"].alias("end"), a["entity_type"].alias("entity_type"), a["start"].alias("start"), a["text"].alias("text")))
        return records.select("split", F.to_json(F.struct(spans.alias("expected"), F.col("case_id").alias("name"), "text")).alias("value"))
    raise ValueError(f"unknown format {kind}")


def export(records: DataFrame, path: str, kind: str) -> None:
    """Write a format, a folder for each split; an existing folder is an error."""
    lines(records, kind).write.partitionBy("split").mode("errorifexists").text(path)


def digest(values: DataFrame) -> str:
    """A hash of all values that doesn't depend on their order or partitions."""
    whole = values.select(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    row = whole.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{row.n}:{row.s or 0}"
