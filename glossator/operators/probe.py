"""Learnability probe: a plain character-n-gram model and how well it tells classes apart.

Features are hashed n-gram counts of unit length. A one-vs-rest logistic
regression is fitted with ``pyspark.ml``, so both features and fitting are
distributed; metrics are grouped counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.functions.arrays import gram_buckets, pieces
from glossator.functions.text import casefold, col
from glossator.sources.intermediate import scope, stored

MINIMUM_TRAIN, MARGIN = 10, 0.05


def tasks(records: DataFrame) -> dict[str, DataFrame]:
    """(split, text, target) of the three questions: is it positive, which label has a value, which label has a context."""
    one = records.filter((F.col("kind") == "positive") & (F.size("annotations") == 1)).select("split", "text", F.col("annotations")[0].alias("a"))
    masked = F.concat(F.substring("text", F.lit(1), F.col("a.start")), F.lit(" <VALUE> "), F.substring(F.col("text"), F.col("a.end") + 1, F.length("text")))
    return {
        "kind": records.select("split", "text", F.when(F.col("kind") == "positive", "positive").otherwise("other").alias("target")),
        "value_label": records.select("split", F.explode("annotations").alias("a")).select("split", F.col("a.text").alias("text"), F.col("a.entity_type").alias("target")),
        "context_label": one.select("split", masked.alias("text"), F.col("a.entity_type").alias("target")),
    }


def gram_counts(docs: DataFrame, id_col: str, text: str | Column, buckets: int = 1 << 18, widths: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(id, bucket, cnt): how often each text has character n-grams of each bucket, in any case; CRC-32 makes the buckets.

    A row's counts are made where the row is and not shuffled; only rows that
    share an id, if there are any, meet to be added up.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in pieces(batch.column("t")):
                row, bucket, count = gram_buckets(raw, at, buckets, widths)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row + lo)), pa.array(bucket.astype(np.int32)), pa.array(count)], names=[id_col, "bucket", "cnt"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), casefold(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, bucket int, cnt bigint")

    again = docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    if again.isEmpty():
        return counted(docs)
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    more = counted(docs.join(again, same, "left_semi")).groupBy(id_col, "bucket").agg(F.sum("cnt").alias("cnt"))
    return counted(docs.join(again, same, "left_anti")).unionByName(more)


def features(examples: DataFrame, text: str | Column = "text", dimension: int = 1 << 18) -> DataFrame:
    """``examples`` with the column features, sparse vectors of unit length: counts of character n-grams, hashed once.

    The vectors are those of ``pyspark.ml``'s HashingTF and Normalizer over the
    n-grams, made from the bytes of many texts at once.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    names = examples.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in pieces(batch.column("__t")):
                row, bucket, count = gram_buckets(raw, at, dimension, kind="murmur3")
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=hi - lo))
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(hi - lo, np.int8)), pa.array(np.full(hi - lo, dimension, np.int32)), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(count / norm[row]))],
                    names=["type", "size", "indices", "values"],
                )
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), vector], names=[*names, "features"])

    made = StructType([*examples.schema.fields, StructField("features", VectorUDT())])
    return examples.select(*names, F.coalesce(casefold(col(text)), F.lit("")).alias("__t")).mapInArrow(run, made)


def metrics(predicted: DataFrame) -> DataFrame:
    """(split, accuracy, balanced_accuracy, macro_f1, majority_baseline, balanced_baseline, classes) of (split, target, prediction)."""
    pairs = predicted.groupBy("split", "target", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0)
    seen = pairs.select("split", F.explode(F.array(F.struct(F.col("target").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("h")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x"))
    each = seen.groupBy("split", F.col("x.c").alias("c")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    f1 = 2 * F.col("h") / (F.col("t") + F.col("p"))
    return each.groupBy("split").agg(
        (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"),
        (F.max("t") / F.sum("t")).alias("majority_baseline"), (1 / F.count_if(F.col("t") > 0)).alias("balanced_baseline"), F.count_if(F.col("t") > 0).alias("classes"),
    )


def probe(examples: DataFrame, train_split: str = "train", dimension: int = 1 << 18, iterations: int = 20) -> tuple[list, str | None]:
    """(metric rows of the other splits, None), or ([], reason) where nothing can be measured.

    The examples are stored, so that neither their making nor a table's many
    parts, most without an example, are repeated for each pass of the fit.
    """
    with scope(examples.sparkSession):
        return _measured(stored(examples.select("split", "text", "target"), "probe-examples"), train_split, dimension, iterations)


def _measured(examples: DataFrame, train_split: str, dimension: int, iterations: int) -> tuple[list, str | None]:
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    counts = examples.groupBy("split", "target").agg(F.count("*").alias("n")).collect()
    own = {r.target: r.n for r in counts if r.split == train_split}
    if sum(own.values()) < MINIMUM_TRAIN:
        return [], f"the training split has {sum(own.values())} examples; at least {MINIMUM_TRAIN} are required"
    if len(own) < 2:
        return [], "the training split has fewer than two classes"
    held = {r.split for r in counts} - {train_split}
    usable = sorted(s for s in held if len({r.target for r in counts if r.split == s}) > 1)
    if not usable:
        return [], "no other split has two classes"
    names = sorted({r.target for r in counts})
    place = F.array_position(F.array(*map(F.lit, names)), F.col("target")) - 1
    ready = features(examples, dimension=dimension).withColumn("label", place.cast("double"))
    base = LogisticRegression(maxIter=iterations, regParam=1e-4)
    model = (base if len(names) == 2 else OneVsRest(classifier=base)).fit(ready.filter(F.col("split") == train_split))
    told = model.transform(ready.filter(F.col("split").isin(usable)))
    named = told.select("split", "target", F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("prediction"))
    return metrics(named).collect(), None
