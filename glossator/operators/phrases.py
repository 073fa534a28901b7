"""N-grams that give away a class or pervade the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.functions.arrays import run_hashes, token_hashes, utf8
from glossator.functions.text import MARKER_TOKEN, SKELETON_TOKEN, ngrams
from glossator.sources.intermediate import stored

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Tokens that a task visits at once, and hashes of n-grams that every task holds; where more are asked for, n-grams are counted as strings.
RUN_TOKENS, HELD_GRAMS = 1 << 19, 4_000_000


def _runs(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, tokens, first token of each row and their end) of runs of rows."""
    ends = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0))))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUN_TOKENS, side="right")) - 1)
        yield lo, column.slice(lo, hi - lo).flatten(), ends[lo : hi + 1] - ends[lo]
        lo = hi


def _grams(flat: pa.Array, first: np.ndarray, widths: tuple[int, ...], plain: bool, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, place, hash) of the n-grams that lie in one row, without placeholders where ``plain``."""
    raw, at = utf8(flat)
    own = token_hashes(raw, at, base)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    marks = np.append(0, np.cumsum(raw[at[0] : at[-1]] == ord("<")))[at - at[0]]
    for w in widths:
        h = run_hashes(own, w)
        good = row[: len(h)] == row[w - 1 :]
        if plain:
            good &= marks[w:] == marks[: len(marks) - w]
        place = np.flatnonzero(good)
        yield w, place, h[place].view(np.int64)


def hash_counts(source: DataFrame, tokens: Column, klass: Column, widths: tuple[int, ...], plain: bool) -> DataFrame:
    """(h, class, n): rows of each class that have an n-gram of the hash."""
    flat = source.select(klass.alias("class"), tokens.alias("t"))
    kind = flat.schema["class"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, flat, first in _runs(batch.column("t")):
                coded = batch.column("class").slice(lo, len(first) - 1).dictionary_encode(null_encoding="encode")
                code = np.asarray(coded.indices)
                found: dict[int, list[np.ndarray]] = {}
                parts = [(np.searchsorted(place, first), h) for _, place, h in _grams(flat, first, widths, plain, BASES[0])]
                for r in range(len(first) - 1):
                    found.setdefault(int(code[r]), []).append(np.unique(np.concatenate([h[cut[r] : cut[r + 1]] for cut, h in parts])))
                for c, each in found.items():
                    h, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h), coded.dictionary.take(pa.array(np.full(len(h), c))), pa.array(n)], names=["h", "class", "n"])

    return flat.mapInArrow(run, f"h bigint, class {kind}, n bigint").groupBy("h", "class").agg(F.sum("n").alias("n"))


def hash_names(source: DataFrame, tokens: Column, hashes: np.ndarray, widths: tuple[int, ...], plain: bool) -> DataFrame | None:
    """(h, feature, width) of the n-grams of the hashes; None if two n-grams share one of them."""
    held = source.sparkSession.sparkContext.broadcast(np.sort(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        named, second = np.zeros(len(known), dtype=bool), np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, flat, first in _runs(batch.column("t")):
                for (w, place, h), (_, _, other) in zip(_grams(flat, first, widths, plain, BASES[0]), _grams(flat, first, widths, plain, BASES[1])):
                    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = np.flatnonzero(known[at] == h) if len(known) else np.empty(0, np.int64)
                    for again in (False, True):  # what is new, then what differs from what was named
                        new = hit[~named[at[hit]]] if not again else hit[second[at[hit]] != other[hit]]
                        new = new[np.unique(at[new], return_index=True)[1]]
                        if not again:
                            named[at[new]], second[at[new]] = True, other[new]
                        text = [" ".join(flat.slice(p, w).to_pylist()) for p in place[new].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(text, pa.string()), pa.array(np.full(len(new), w, np.int32))], names=["h", "feature", "width"])

    found = source.select(tokens.alias("t")).mapInArrow(run, "h bigint, feature string, width int")
    names = stored(found.groupBy("h").agg(F.min("feature").alias("feature"), F.max("feature").alias("other"), F.min("width").alias("width")), "gram-names")
    return None if names.filter("feature <> other").limit(1).count() else names.select("h", "feature", "width")


def gram_counts(source: DataFrame, tokens: Column, klass: str, widths=(1, 2, 3)) -> DataFrame:
    """(feature, width, class, n): rows of each class that have the n-gram; n-grams with a placeholder are left out."""

    def of_width(w: int) -> Column:
        return F.transform(F.array_distinct(ngrams(tokens, w)), lambda g: F.struct(g.alias("feature"), F.lit(w).alias("width")))

    grams = F.flatten(F.array(*map(of_width, widths)))
    plain = F.filter(grams, lambda g: ~g["feature"].contains("<"))
    flat = source.select(F.col(klass).alias("class"), F.explode_outer(plain).alias("g")).filter("g is not null")
    return flat.groupBy(F.col("g.feature").alias("feature"), F.col("g.width").alias("width"), "class").agg(F.count("*").alias("n"))


def class_markers(source: DataFrame, tokens: Column, klass: str, least_support: int, widths=(1, 2, 3)) -> DataFrame:
    """(feature, width, class, class_n, support, class_total): the commonest class of each n-gram; of equals the smaller.

    N-grams are counted by a hash; those with support are then named, each
    once in a task. Should two share a hash, or too many have support, all
    are counted as strings. The classes' totals are few and broadcast.
    """
    totals = source.groupBy(F.col(klass).alias("class")).agg(F.count("*").alias("class_total"))
    least = lambda counts, *keys: counts.groupBy(*keys).agg(F.sum("n").alias("support"), F.min(F.struct((-F.col("n")).alias("n"), "class")).alias("b")).filter(F.col("support") >= least_support)
    kept = stored(least(hash_counts(source, tokens, F.col(klass), tuple(widths), True), "h"), "gram-support")
    hashes = np.asarray(kept.select("h").limit(HELD_GRAMS + 1).toArrow().column("h"))
    names = hash_names(source, tokens, hashes, tuple(widths), True) if len(hashes) <= HELD_GRAMS else None
    best = kept.join(names, "h") if names is not None else least(gram_counts(source, tokens, klass, widths), "feature", "width")
    return best.select("feature", "width", F.col("b.class").alias("class"), (-F.col("b.n")).alias("class_n"), "support").join(F.broadcast(totals), "class").select("feature", "width", "class", "class_n", "support", "class_total")


def offending(markers: DataFrame, most_share: float, least_coverage: float) -> DataFrame:
    share, coverage = F.col("class_n") / F.col("support"), F.col("class_n") / F.col("class_total")
    return markers.withColumns({"share": share, "coverage": coverage}).filter((share > most_share) & (coverage >= least_coverage))


def marker_tokens(skeletons: Column) -> Column:
    return F.regexp_extract_all(skeletons, F.lit(MARKER_TOKEN), F.lit(0))


def pervasive(source: DataFrame, skeletons: Column, width: int = 4) -> DataFrame:
    """(gram, df): rows that have each n-gram of the skeletons, placeholders and number marks included."""
    tokens = F.regexp_extract_all(skeletons, F.lit(SKELETON_TOKEN), F.lit(0))
    return source.select(F.explode_outer(F.array_distinct(ngrams(tokens, width))).alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count("*").alias("df"))


def most_pervasive(source: DataFrame, skeletons: Column, limit: int, width: int = 4) -> DataFrame:
    """The first ``limit`` rows of :func:`pervasive` by falling df and gram.

    Counted by a hash, then those that can be among the first are named. Should
    two share a hash, or too many be level, all are counted as strings.
    """
    tokens = F.regexp_extract_all(skeletons, F.lit(SKELETON_TOKEN), F.lit(0))
    # What is in one row only is not first where enough others are in more.
    counts = stored(hash_counts(source, tokens, F.lit(""), (width,), False).select("h", F.col("n").alias("df")).filter("df > 1"), "gram-counts")
    top = counts.select("df").orderBy(F.desc("df")).limit(limit).collect()
    if len(top) < limit:
        return pervasive(source, skeletons, width).orderBy(F.desc("df"), "gram").limit(limit)
    kept = counts.filter(F.col("df") >= min(r.df for r in top))
    hashes = np.asarray(kept.select("h").limit(HELD_GRAMS + 1).toArrow().column("h"))
    names = hash_names(source, tokens, hashes, (width,), False) if len(hashes) <= HELD_GRAMS else None
    found = kept.join(names, "h").select(F.col("feature").alias("gram"), "df") if names is not None else pervasive(source, skeletons, width)
    return found.orderBy(F.desc("df"), "gram").limit(limit)
