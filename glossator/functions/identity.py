"""Identities of records, derived from their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(prefix: str, *parts: Column) -> Column:
    """A prefix and 20 digits of the hash of the parts; null where a part is null."""
    joined = [x for p in parts for x in (F.lit("|"), p.cast("string"))][1:]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*joined), 256), 1, 20))


def external_id(split: Column, index: Column, text: Column) -> Column:
    return short_hash("ext-", split, index, text)


def generated_id(digest: str, version: str, split: Column, family: Column, index: Column, text: Column) -> Column:
    return short_hash("gc-", F.lit(digest), F.lit(version), split, family, index, text)


def import_id(family: Column, annotations: Column, text: Column) -> Column:
    body = F.to_json(F.struct(annotations.alias("annotations"), family.alias("family"), text.alias("text")))
    return F.concat(F.lit("human-"), F.substring(F.sha2(body, 256), 1, 20))


NAMESPACE = r"^glossator/(train|eval|holdout)/([a-z][a-z0-9_]{1,63})/([0-9]{5,})$"


def namespace(split: Column, family: Column, index: Column) -> Column:
    return F.concat_ws("/", F.lit("glossator"), split, family, F.format_string("%05d", index))


def namespace_index(space: Column, split: Column, family: Column) -> Column:
    """The index of a namespace that agrees with the record; null otherwise."""
    good = (F.regexp_extract(space, NAMESPACE, 1) == split) & (F.regexp_extract(space, NAMESPACE, 2) == family)
    return F.when(good, F.regexp_extract(space, NAMESPACE, 3).cast("int"))
