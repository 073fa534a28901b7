"""Readers: record files, foreign span and token formats, marked text, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossator.functions.identity import external_id, import_id
from glossator.functions.text import code_point
from glossator.operators.spans import annotation, decoded, parsed
from glossator.schema import ANNOTATIONS, CUE_LINKS, RECORD, RECORD_VERSION

from .intermediate import stored

_SPAN = "array<struct<start: int, end: int, entity_type: string, label: string>>"
_BAD, _FILE = "_corrupt", "_file"


def _lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON objects, one a line, under a fixed schema; a malformed line stops the job and names its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(_FILE)).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"), _FILE).select("r.*", _FILE)
    where = F.concat(F.lit("invalid JSON record in "), F.col(_FILE), F.lit(": "), F.substring(_BAD, 1, 200))
    good = F.when(F.col(_BAD).isNull(), F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))
    return rows.filter(good).drop(_BAD)


def malformed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line, value) of the lines that are no JSON object under the schema; lines are counted from 1.

    A line's number is its place in its piece of the file and the lines of the
    pieces before, so this shuffles all lines: it is for when there are some.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    found = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    told = lines.withColumn("bad", (F.trim("value") != "") & found[_BAD].isNotNull())
    order = Window.partitionBy("file").orderBy("block", "mid")
    return told.withColumn("line", F.row_number().over(order)).filter("bad").select("file", "line", "value")


def refuse_malformed(spark: SparkSession, path: str | list[str], schema: str) -> None:
    """Raise with the file and line of the first malformed line, if there is one."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    found = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    if lines.filter(found[_BAD].isNotNull()).limit(1).count():
        first = malformed(spark, path, schema).orderBy("file", "line").first()
        raise ValueError(f"invalid JSON record at {first.file.rpartition('/')[2]}:{first.line}: {first.value[:80]}")


RECORD_FIELDS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RECORD.fields)
PREDICTION_FIELDS = f"id string, spans {_SPAN}"


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Record files as written by :func:`glossator.plans.corpus.write`."""
    return _lines(spark, path, RECORD_FIELDS).drop(_FILE)


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, spans) of prediction files; ``label`` is another name for ``entity_type``."""
    rows = _lines(spark, path, PREDICTION_FIELDS)
    return rows.select("id", F.transform(F.coalesce("spans", F.array().cast(_SPAN)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["entity_type"], s["label"]).alias("entity_type"))).alias("spans"))


def as_records(rows: DataFrame) -> DataFrame:
    """Records of ``rows(ord, split, text, spans)``; spans are (start, end, entity_type) in code points, sorted here.

    The index in the identity runs over all sources in the order of ``ord``.
    It is made from the counts of the partitions of a range sort, not by
    bringing all rows into one. The sorted rows are a stored table, which goes
    with the scope that it is read in.
    """
    place = rows.select(*rows.columns, F.monotonically_increasing_id().alias("mid")).repartitionByRange("ord", "mid").sortWithinPartitions("ord", "mid")
    # Stored, so that a row's partition and place in it are decided once.
    placed = stored(place.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed-rows")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.join(F.broadcast(start), "part").withColumn("index", F.col("before") + F.col("k"))
    spans = F.array_sort(F.transform("spans", lambda s: annotation(s["entity_type"], s["start"], s["end"], F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), F.col("text"))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    return numbered.select(
        external_id(F.col("split"), F.col("index"), F.col("text")).alias("case_id"), "split", F.lit("external").alias("family"), F.concat(F.lit("external/"), F.col("index")).alias("namespace"), F.lit("external").alias("template_id"),
        F.when(F.size("spans") > 0, "positive").otherwise("unannotated").alias("kind"), F.lit("external").alias("provenance"), "text", spans.alias("annotations"), F.array().cast(CUE_LINKS).alias("cue_links"),
        *(F.lit(None).cast("string").alias(c) for c in ("persona", "organization", "cue_surface", "hard_negative_kind")), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(RECORD_VERSION).alias("schema_version"),
    )


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type")))


def _jsonl(spark, path, split, byte_offsets):
    rows = _lines(spark, path, f"text string, spans {_SPAN}, annotations {_SPAN}, split string")
    both = F.coalesce("spans", "annotations", F.array().cast(_SPAN))
    place = (lambda at: code_point(F.col("text"), at)) if byte_offsets else (lambda at: at)
    own = F.transform(both, lambda s: F.struct(place(s["start"]).alias("start"), place(s["end"]).alias("end"), F.coalesce(s["entity_type"], s["label"]).alias("entity_type")))
    bad = F.exists(own, lambda s: F.coalesce((s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length("text")), F.lit(True)))
    checked = F.when(~bad, own).otherwise(F.raise_error(F.concat(F.lit("span out of bounds in "), F.col(_FILE))).cast("array<struct<start: int, end: int, entity_type: string>>"))
    return rows.select(F.coalesce("split", F.lit(split)).alias("split"), "text", checked.alias("spans"))


def _from_tags(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``texts(split, key, text, offsets)`` with the spans of ``tokens(key, pos, tag)``."""
    found = decoded(tokens, ["key"]).groupBy("key").agg(F.collect_list(F.struct("first_pos", "last_pos", "label")).alias("found"))
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<first_pos: int, last_pos: int, label: string>>")), lambda f: F.struct(F.element_at("offsets", f["first_pos"] + 1)[0].alias("start"), F.element_at("offsets", f["last_pos"] + 1)[1].alias("end"), f["label"].alias("entity_type")))
    return texts.join(found, "key", "left").select("split", "text", spans.alias("spans"))


def joined_offsets(tokens: Column) -> Column:
    """Offsets of tokens in their text when they are joined by spaces."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(tokens, empty, lambda s, t: F.struct((s["at"] + F.length(t) + 1).alias("at"), F.concat(s["out"], F.array(F.array(s["at"], s["at"] + F.length(t)))).alias("out")))["out"]


def _hf(spark, path, split):
    rows = _lines(spark, path, "tokens array<string>, ner_tags array<string>, text string, token_offsets array<array<int>>, split string").withColumn("key", F.monotonically_increasing_id())
    whole = F.col("text").isNotNull() & F.col("token_offsets").isNotNull()
    texts = rows.select("key", F.coalesce("split", F.lit(split)).alias("split"), F.when(whole, F.col("text")).otherwise(F.array_join("tokens", " ")).alias("text"), F.when(whole, F.col("token_offsets")).otherwise(joined_offsets(F.col("tokens"))).alias("offsets"))
    return _from_tags(rows.select("key", F.posexplode("ner_tags").alias("pos", "tag")), texts)


def _conll(spark, path, split):
    """Sentences of token lines; files are read in pieces that end at blank lines, however large."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("block"))
    lines = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("-DOCSTART-"))
    cells = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    checked = F.when(~F.exists(cells, lambda c: F.size(c) < 2), cells).otherwise(F.raise_error(F.lit("a token line has fewer than two columns")).cast("array<array<string>>"))
    rows = blocks.select(checked.alias("cells")).filter(F.size("cells") > 0).withColumn("key", F.monotonically_increasing_id())
    rows = rows.select("key", F.transform("cells", lambda c: c[0]).alias("tokens"), F.transform("cells", lambda c: F.element_at(c, -1)).alias("ner_tags"))
    texts = rows.select("key", F.lit(split).alias("split"), F.array_join("tokens", " ").alias("text"), joined_offsets(F.col("tokens")).alias("offsets"))
    return _from_tags(rows.select("key", F.posexplode("ner_tags").alias("pos", "tag")), texts)


def read_external(spark: SparkSession, sources: dict[str, str], kind: str = "jsonl", byte_offsets: bool = False) -> DataFrame:
    """Records of foreign data sets, ``{split: path}``, in the format jsonl, hf or conll.

    A record's own split goes before its source's. Only jsonl can have byte
    offsets. No input at all is an error.
    """
    if not sources:
        raise ValueError("no sources given")
    if kind not in ("jsonl", "hf", "conll"):
        raise ValueError(f"unknown format {kind}")
    if byte_offsets and kind != "jsonl":
        raise ValueError("only jsonl has byte offsets")
    out = None
    for place, (split, path) in enumerate(sources.items()):
        rows = _jsonl(spark, path, split, byte_offsets) if kind == "jsonl" else (_hf if kind == "hf" else _conll)(spark, path, split)
        rows = rows.select(F.lit(place).alias("ord"), "split", "text", _plain(F.col("spans")).alias("spans"))
        out = rows if out is None else out.unionByName(rows)
    return as_records(out)


def marked_entries(spark: SparkSession, path: str, family: str = "human_supplied") -> DataFrame:
    """(number, family, marked) of the lines that are not blank, numbered from 1; JSON lines give text and family."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim("value") != "")
    place = stored(lines.repartitionByRange("file", "block").withColumns({"part": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}), "entries")
    start = place.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.from_json("value", "text string, family string")
    json = F.startswith(F.ltrim("value"), F.lit("{"))
    numbered = place.join(F.broadcast(start), "part").withColumn("number", F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return numbered.select("number", F.coalesce(F.when(json, own["family"]), F.lit(family)).alias("family"), F.when(json, own["text"]).otherwise(F.col("value")).alias("marked"))


def imported(entries: DataFrame) -> DataFrame:
    """Records of ``entries(family, m)``, m being what :func:`spans.parsed` gives for good marks."""
    case = import_id(F.col("family"), F.col("m.annotations"), F.col("m.text"))
    return entries.select(
        case.alias("case_id"), F.lit("unassigned").alias("split"), "family", F.concat(F.lit("glossator/import/"), case).alias("namespace"), F.lit("human_supplied").alias("template_id"),
        F.when(F.size("m.annotations") > 0, "positive").otherwise("unannotated").alias("kind"), F.lit("human_supplied").alias("provenance"), "m.text", F.col("m.annotations").cast(ANNOTATIONS).alias("annotations"), F.array().cast(CUE_LINKS).alias("cue_links"),
        *(F.lit(None).cast("string").alias(c) for c in ("persona", "organization", "cue_surface", "hard_negative_kind")), F.create_map(F.lit("release_status"), F.lit("unreviewed")).alias("metadata"), F.lit(RECORD_VERSION).alias("schema_version"),
    )


def read_marked(spark: SparkSession, path: str, family: str = "human_supplied", labels: list[str] | None = None) -> DataFrame:
    """Records of marked texts, plain lines or JSON lines with text and family; a malformed mark stops the job."""
    rows = marked_entries(spark, path, family).withColumn("m", parsed(F.col("marked")))
    fault = F.when(F.col("marked").isNull(), F.lit("no text")).otherwise(F.col("m.fault"))
    if labels is not None:
        fault = F.coalesce(fault, F.when(F.exists("m.annotations", lambda a: ~a["entity_type"].isin(labels)), F.lit("label that is not configured")))
    good = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("record "), F.col("number"), F.lit(": "), fault)).cast("boolean"))
    return imported(rows.filter(good))
