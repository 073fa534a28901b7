"""Shapes, diversity and affixes of annotated values; balance of families, templates and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossator.functions.text import IDENTIFIER, casefold, let, matches, shape, whole


def values(records: DataFrame) -> DataFrame:
    """(split, family, label, value), one row for each annotation."""
    return records.select("split", "family", F.explode("annotations").alias("a")).select("split", "family", F.col("a.entity_type").alias("label"), F.col("a.text").alias("value"))


def shape_entity(records: DataFrame, pattern: str = IDENTIFIER) -> DataFrame:
    """(shape, annotated, support): how often values of a shape are annotated, of all their occurrences."""
    inside = records.select(F.explode("annotations.text").alias("v")).filter(whole("v", pattern)).select(shape("v").alias("shape"), F.lit(1).alias("a"))
    taken = F.coalesce(F.transform("annotations", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))), F.array().cast("array<struct<start: int, end: int>>"))
    free = let(taken, lambda spans: F.filter(matches("text", pattern), lambda m: ~F.exists(spans, lambda a: (a["start"] < m["end"]) & (m["start"] < a["end"]))))
    outside = records.select(F.explode_outer(free).alias("m")).filter("m is not null").select(shape("m.text").alias("shape"), F.lit(0).alias("a"))
    return inside.unionByName(outside).groupBy("shape").agg(F.sum("a").alias("annotated"), F.count("*").alias("support")).filter("annotated > 0")


def shape_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, shape, labels, top, total): labels of ``labels(name, morphology_group)`` that values of a shape carry.

    Only groups of several labels count; unknown labels are left out.
    """
    many = labels.groupBy("morphology_group").agg(F.count_distinct("name").alias("k")).filter("k > 1").select("morphology_group")
    known = F.broadcast(labels.join(many, "morphology_group").select(F.col("name").alias("label"), F.col("morphology_group").alias("group")))
    each = values(records).join(known, "label").groupBy("group", shape("value").alias("shape"), "label").agg(F.count("*").alias("n"))
    return each.groupBy("group", "shape").agg(F.count("*").alias("labels"), F.max("n").alias("top"), F.sum("n").alias("total"))


def distinct_values(records: DataFrame) -> DataFrame:
    """(label, distinct_n, occurrences)."""
    return values(records).groupBy("label").agg(F.count_distinct("value").alias("distinct_n"), F.count("*").alias("occurrences"))


def value_entropy(records: DataFrame) -> DataFrame:
    """One row, (bits): Shannon entropy of the annotated values."""
    each = values(records).groupBy("value").agg(F.count("*").alias("n"))
    # sum p log p = (sum n log n) / N - log N, so one pass is enough
    total = F.sum("n").cast("double")
    return each.agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("bits"))


def affixes(records: DataFrame) -> DataFrame:
    """(label, side, width, affix, n, total): the commonest affix of each width among a label's distinct values.

    Of equally common ones the smallest counts. Labels with one value have none.
    """
    distinct = values(records).select("label", "value").filter("length(value) > 0").distinct()
    total = distinct.groupBy("label").agg(F.count("*").alias("total")).filter("total > 1")
    width = F.explode(F.sequence(F.lit(1), F.length("value")))
    cut = distinct.select("label", "value", width.alias("width")).select(
        "label", "width", F.explode(F.array(F.struct(F.lit("prefix").alias("side"), F.substring("value", F.lit(1), F.col("width")).alias("affix")), F.struct(F.lit("suffix").alias("side"), F.expr("right(value, width)").alias("affix")))).alias("x")
    )
    counts = cut.groupBy("label", F.col("x.side").alias("side"), "width", F.col("x.affix").alias("affix")).agg(F.count("*").alias("n"))
    best = counts.groupBy("label", "side", "width").agg(F.min(F.struct((-F.col("n")).alias("n"), "affix")).alias("b"))
    return best.select("label", "side", "width", F.col("b.affix").alias("affix"), (-F.col("b.n")).alias("n")).join(F.broadcast(total), "label")


def dominant_affixes(records: DataFrame, share: float = 0.5) -> DataFrame:
    """(label, side, width, affix, n, total): the longest affix that at least the share of a label's values has."""
    most = affixes(records).filter(F.col("n") >= F.lit(share) * F.col("total"))
    return most.withColumn("k", F.row_number().over(Window.partitionBy("label", "side").orderBy(F.desc("width")))).filter("k = 1").drop("k")


def shares(records: DataFrame, column: str) -> DataFrame:
    """(column, n, total) of each value of a column."""
    counts = records.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))


def cells(records: DataFrame, families: DataFrame, splits: DataFrame, value: str | Column = "template_id") -> DataFrame:
    """(split, family, n): distinct values in each cell of the whole grid; 0 where there is none."""
    v = F.col(value) if isinstance(value, str) else value
    found = records.groupBy("split", "family").agg(F.count_distinct(v).alias("n"))
    grid = F.broadcast(splits.crossJoin(families))
    return grid.join(found, ["split", "family"], "left").select("split", "family", F.coalesce("n", F.lit(0)).alias("n"))


def split_counts(records: DataFrame) -> DataFrame:
    """(split, records, positives, negatives, families, templates, personas, organizations)."""
    return records.groupBy("split").agg(
        F.count("*").alias("records"), F.count_if(F.col("kind") == "positive").alias("positives"), F.count_if(F.col("kind") == "hard_negative").alias("negatives"),
        F.count_distinct("family").alias("families"), F.count_distinct("template_id").alias("templates"), F.count_distinct("persona").alias("personas"), F.count_distinct("organization").alias("organizations"),
    )


def cue_shortcuts(records: DataFrame) -> DataFrame:
    """(split, with_cues, exclusive_records, exclusive_cues): cues that occur with one label only, and the records that have one.

    A link counts where the text shows the cue and an annotation has the label.
    """
    labels = F.transform("annotations", lambda a: a["entity_type"])
    good = F.filter("cue_links", lambda c: casefold("text").contains(casefold(c["cue"])) & F.array_contains(labels, c["entity_type"]))
    pairs = F.array_distinct(F.transform(good, lambda c: F.struct(casefold(c["cue"]).alias("cue"), c["entity_type"].alias("label"))))
    held = records.filter(F.size("annotations") > 0).select("split", F.monotonically_increasing_id().alias("rid"), F.explode(pairs).alias("p")).select("split", "rid", "p.cue", "p.label")
    each = held.groupBy("split", "rid", "cue").agg(F.lit(1).alias("one"))
    kinds = held.groupBy("split", "cue").agg(F.count_distinct("label").alias("labels"))
    by_record = each.join(kinds, ["split", "cue"]).groupBy("split", "rid").agg(F.max((F.col("labels") == 1).cast("int")).alias("x"))
    counted = by_record.groupBy("split").agg(F.count("*").alias("with_cues"), F.sum("x").alias("exclusive_records"))
    names = kinds.filter("labels = 1").groupBy("split").agg(F.array_sort(F.collect_list("cue")).alias("exclusive_cues"))
    return counted.join(names, "split", "left").select("split", "with_cues", "exclusive_records", F.coalesce("exclusive_cues", F.array().cast("array<string>")).alias("exclusive_cues"))
