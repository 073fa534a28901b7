"""Spans: their rules, token tags in both directions, and inline markup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossator.functions.arrays import pieces, tokens
from glossator.functions.text import byte_offset, code_point, let
from glossator.schema import ANNOTATIONS

LABEL = "[A-Z][A-Z0-9_]{1,63}"
MARK = r"\[\[([^\[\]:]*):((?:[^\[\]]|\[(?!\[)|\](?!\]))*)\]\]"


def annotation(label: Column, start: Column, end: Column, text: Column, source: Column) -> Column:
    """An annotation struct with its byte offsets."""
    return F.struct(label.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), byte_offset(source, start).alias("byte_start"), byte_offset(source, end).alias("byte_end"), text.alias("text"))


def span_faults(text: str, annotations: str) -> Column:
    """Sorted distinct faults of a record's spans: bounds, overlap, text, bytes."""
    t, spans = F.col(text), F.coalesce(F.col(annotations), F.array().cast(ANNOTATIONS))
    order = F.array_sort(F.transform(spans, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))))
    bounds = F.exists(spans, lambda a: F.coalesce((a["start"] < 0) | (a["start"] >= a["end"]) | (a["end"] > F.length(t)), F.lit(True)))
    overlap = F.exists(F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)
    differs = F.exists(spans, lambda a: F.coalesce(F.substring(t, a["start"] + 1, a["end"] - a["start"]) != a["text"], F.lit(True)))
    misplaced = F.exists(spans, lambda a: F.coalesce((byte_offset(t, a["start"]) != a["byte_start"]) | (byte_offset(t, a["end"]) != a["byte_end"]), F.lit(True)))
    tests = [(bounds, "bounds"), (overlap, "overlap"), (~bounds & differs, "text"), (~bounds & misplaced, "bytes")]
    return F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests))))


def from_bytes(text: Column, spans: Column) -> Column:
    """Spans with byte offsets turned into code points; null offsets where a byte is inside a character."""
    return F.transform(spans, lambda s: F.struct(code_point(text, s["start"]).alias("start"), code_point(text, s["end"]).alias("end"), s["entity_type"].alias("entity_type")))


def _tags(begin: np.ndarray, end: np.ndarray, own: list[dict]) -> list[str | None]:
    """The tags of one text's tokens under its spans."""
    tag: list[str | None] = ["O"] * len(begin)
    met = np.zeros(len(begin), dtype=np.int64)
    for a in own:
        if a["start"] is None or a["end"] is None or a["start"] >= a["end"]:
            continue
        first, last = np.searchsorted(end, a["start"], side="right"), np.searchsorted(begin, a["end"], side="left")
        met[first:last] += 1
        head = a["start"] + len(a["text"] or "") - len((a["text"] or "").lstrip())
        for k in range(first, last):
            inside = a["start"] <= begin[k] and end[k] <= a["end"] and met[k] == 1 and a["label"] is not None
            tag[k] = ("B-" if begin[k] == head else "I-") + a["label"] if inside else None
    return tag


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, list[tuple[int, slice, list[str | None]]]]]:
    """(first row, row, start, end, token, first token of each row, (row, place of its tokens, tags) of the rows with spans) of pieces of a batch."""
    spans = batch.column("spans")
    many = np.asarray(spans.value_lengths().fill_null(0))
    for lo, hi, raw, at in pieces(batch.column("t")):
        row, begin, end, token = tokens(raw, at)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        held = []
        for r in np.flatnonzero(many[lo:hi]):
            place = slice(int(first[r]), int(first[r + 1]))
            held.append((int(r), place, _tags(begin[place], end[place], spans[lo + int(r)].as_py())))
        yield lo, row, begin, end, token, first, held


def _tagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, row, begin, end, token, first, held in _cut(batch):
            names: dict[str | None, int] = {"O": 0}
            code = np.zeros(len(row), dtype=np.int32)
            for _, place, tags in held:
                code[place] = [names.setdefault(t, len(names)) for t in tags]
            pos = (np.arange(len(row)) - first[row]).astype(np.int32)
            rows = pa.array(row + lo)
            own = [c for c in ("id", "split") if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in own), pa.array(pos), pa.array(begin), pa.array(end), token, pa.array([*names], pa.string()).take(pa.array(code))],
                names=[*own, "pos", "start", "end", "token", "tag"],
            )


def _untagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, begin, end, _, _, held in _cut(batch):
            found: list[tuple[int, int, str, int, int]] = []
            for r, place, tags in held:
                spans: list[list] = []
                before = None
                for tag, s, e in zip(tags, begin[place].tolist(), end[place].tolist()):
                    label = None if tag is None or tag == "O" else tag[2:]
                    if label is not None and (before is None or before != label or tag[:1] == "B"):
                        spans.append([label, s, e])
                    elif label is not None:
                        spans[-1][2] = e
                    before = label
                found += [(lo + r, k, *x) for k, x in enumerate(spans, 1)]
            at, no, label, start, last = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(label, pa.string()), pa.array(start, pa.int32()), pa.array(last, pa.int32())], names=["id", "span_no", "label", "start", "end"])


def _with_spans(records: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    spans = F.transform("annotations", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["entity_type"].alias("label"), a["text"].alias("text")))
    own = records.select(F.col(id_col).alias("id"), "split", F.col("text").alias("t"), spans.alias("spans"))
    return own, own.schema["id"].dataType.simpleString()


def tagged(records: DataFrame, id_col: str = "case_id", with_split: bool = True) -> DataFrame:
    """(id, split, pos, start, end, token, tag): BIO tags of every token; ``split`` only where it is asked for.

    The tag is null where an entity cuts through a token or a token meets
    several; exporters refuse such records. A text is cut and its spans are
    laid over its tokens in one visit, in Arrow batches. A null text has no
    tokens, null annotations are none.
    """
    own, kind = _with_spans(records, id_col)
    own, split = (own, "split string, ") if with_split else (own.drop("split"), "")
    return own.mapInArrow(_tagger, f"id {kind}, {split}pos int, start int, end int, token string, tag string").withColumnRenamed("id", id_col)


def retold(records: DataFrame, id_col: str = "case_id") -> DataFrame:
    """(id, span_no, label, start, end): the spans that the tags of :func:`tagged` tell, null tags read as O.

    The rules are those of :func:`decoded`. A record's tags are decoded where
    they are made, so no token is shuffled; ids must be unique.
    """
    own, kind = _with_spans(records, id_col)
    return own.mapInArrow(_untagger, f"id {kind}, span_no int, label string, start int, end int").withColumnRenamed("id", id_col)


def decoded(tags: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span_no, label, first_pos, last_pos) from ``tags(keys, pos, tag)`` in BIO or BILOU.

    A span opens at B or U, at a change of label, and at an I or L that no
    span is open for; O closes. Unknown prefixes raise.
    """
    head, label = F.upper(F.substring("tag", 1, 2)), F.expr("substring(tag, 3)")
    known = (F.col("tag") == "O") | head.isin("B-", "I-", "L-", "U-", "E-", "S-")
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = tags.withColumn("tag", F.when(known, F.col("tag")).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce("tag", F.lit("null"))))))
    rows = rows.withColumns({"label": F.when(F.col("tag") != "O", label), "open": head.isin("B-", "U-", "S-")})
    before = F.lag("label").over(order)
    ended = F.coalesce(F.lag(head.isin("U-", "L-", "E-", "S-")).over(order), F.lit(False))
    begins = F.col("label").isNotNull() & (F.col("open") | before.isNull() | (before != F.col("label")) | (ended & F.col("open")))
    numbered = rows.withColumn("b", begins.cast("int")).withColumn("span_no", F.sum("b").over(order))
    spans = numbered.filter("label is not null").groupBy(*keys, "span_no").agg(F.first("label").alias("label"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return spans.withColumn("span_no", F.col("span_no").cast("int"))


def parsed(marked: Column) -> Column:
    """struct<text, annotations, fault> of a text with ``[[LABEL:value]]`` marks.

    ``fault`` is null for a good text; else it says what is wrong, and text
    and annotations are null. Labels and values lose white space around them.
    """

    def cut(m: Column) -> Column:
        own = lambda k: F.transform(F.regexp_extract_all(m, F.lit(MARK), F.lit(k)), lambda x: F.trim(x))
        return F.struct(own(1).alias("labels"), own(2).alias("values"), F.split(m, MARK, -1).alias("gaps"))

    def joined(p: Column) -> Column:
        clean = F.array_join(F.zip_with(p["gaps"], p["values"], lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label: string, start: int, end: int, text: string>>").alias("out"))

        def step(seen: Column, x: Column) -> Column:
            begin = seen["at"] + F.length(x["gap"])
            end = begin + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(seen["out"], F.array(F.struct(x["label"].alias("label"), begin.alias("start"), end.alias("end"), x["value"].alias("text")))).alias("out"))

        pairs = F.zip_with(p["labels"], p["values"], lambda k, v: F.struct(k.alias("label"), v.alias("value")))
        parts = F.zip_with(pairs, p["gaps"], lambda x, g: F.struct(x["label"].alias("label"), x["value"].alias("value"), g.alias("gap")))
        spans = F.aggregate(F.filter(parts, lambda x: x["label"].isNotNull()), start, step)["out"]
        fault = (
            F.when(F.exists(p["gaps"], lambda g: g.rlike(r"\[\[(?!.*\]\])")), "unclosed mark").when(F.exists(p["gaps"], lambda g: g.contains("[[") & ~g.contains(":")), "mark without label")
            .when(F.exists(p["gaps"], lambda g: g.contains("[[") | g.contains("]]")), "stray or nested mark").when(F.exists(p["labels"], lambda x: ~x.rlike(rf"\A{LABEL}\z")), "malformed label").when(F.exists(p["values"], lambda v: v == ""), "empty value")
        )
        return F.struct(clean.alias("clean"), spans.alias("spans"), fault.alias("fault"))

    def full(x: Column) -> Column:
        each = F.transform(x["spans"], lambda s: annotation(s["label"], s["start"], s["end"], s["text"], x["clean"]))
        good = x["fault"].isNull()
        return F.struct(F.when(good, x["clean"]).alias("text"), F.when(good, each).alias("annotations"), x["fault"].alias("fault"))

    # Each step is bound once for a row; written out in place it would be repeated for every mark.
    return let(let(let(marked, cut), joined), full)


def rendered(text: Column, annotations: Column) -> Column:
    """The inverse of :func:`parsed`: marks put around the spans."""
    order = F.array_sort(F.transform(annotations, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["entity_type"].alias("label"), a["text"].alias("text"))))
    seen = F.aggregate(
        order, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, a: F.struct(F.concat(s["done"], F.substring(text, s["at"] + 1, a["start"] - s["at"]), F.lit("[["), a["label"], F.lit(":"), a["text"], F.lit("]]")).alias("done"), a["end"].alias("at")),
    )
    return F.concat(seen["done"], F.substring(text, seen["at"] + 1, F.length(text)))
