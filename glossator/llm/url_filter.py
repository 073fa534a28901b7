"""URL filter by the ratio of two character language models.

Two Markov models of variable order are counted from labelled URLs, one from
accepted, one from rejected ones. A context has up to ``order`` characters. A
character is predicted from the longest context that the model has.
Predictions are smoothed by interpolating each context with the next shorter
one (Witten and Bell's weights) down to a uniform one.

A URL's score is the difference of its log-likelihoods, rejected minus
accepted, divided by its length. The threshold is calibrated on labelled URLs
that were not counted.

The counts are those of windows of ``order + 1`` characters, so a URL sends
each window once, combined before the shuffle; shorter contexts come from the
distinct windows. The models grow with the labelled URLs and are never
gathered in one place: they are tables by context, and windows meet them by
joins. Each distinct window is scored once. Its probability is built from that
of its shorter ends, level by level, so no key of these joins has more rows
than there are different characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

ORDER = 5
LEAST_COUNT = 2
ALPHABET = 4096
FALSE_REJECTS = 0.01
FOLDS = 5
START, END = "\x02", "\x03"
#: Windows are cut from pieces of so many characters, as finding a place in a string takes time in proportion to it.
PIECE = 512
#: Words of hosts that seed the rejected class of the query.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "track")


@dataclass
class Model:
    """Counts after each context, their sum and the number of different characters."""

    order: int
    after: dict[str, dict[str, int]]

    def __post_init__(self):
        self.totals = {c: (sum(own.values()), len(own)) for c, own in self.after.items()}

    def log_probability(self, window: str) -> float:
        """Of the window's last character after the others."""
        past, char = window[:-1], window[-1]
        p = 1 / ALPHABET
        for k in range(len(past) + 1):
            context = past[len(past) - k :]
            if context not in self.totals:
                break
            total, kinds = self.totals[context]
            p = (self.after[context].get(char, 0) + kinds * p) / (total + kinds)
        return math.log(p)


def windows(url: Column, order: int = ORDER) -> Column:
    """All windows of ``order`` characters and the one after them, from the first character to the end mark."""
    padded = F.concat(F.lit(START * order), url, F.lit(END))
    pieces = F.transform(F.sequence(F.lit(1), F.length(url) + 1, F.lit(PIECE)), lambda i: F.substring(padded, i, F.lit(PIECE + order)))
    return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - order), lambda i: F.substring(p, i, F.lit(order + 1)))))


def held_out(url: Column, folds: int = FOLDS) -> Column:
    """URLs that calibrate: one fold of ``folds``, by a hash, so that repeats of a URL fall together."""
    return F.pmod(F.xxhash64(url, F.lit(3)), F.lit(folds)) == 0


def ends(window: Column, order: int = ORDER) -> Column:
    """The last 1, 2, ... ``order + 1`` characters of a window, one row each."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring(window, F.lit(order + 2) - k, k)))


def _context(gram: str = "gram") -> Column:
    return F.substring(F.col(gram), F.lit(1), F.length(gram) - 1)


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n0, n1): how often ``labelled(url, label)`` has each context with its next character, by label."""
    flat = labelled.select("label", F.explode_outer(windows(F.col("url"), order)).alias("window"))
    each = flat.groupBy("window").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    return each.select(ends(F.col("window"), order).alias("gram"), "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def contexts_of(grams: DataFrame, least_count: int = LEAST_COUNT, max_contexts: int | None = None) -> DataFrame:
    """(context, t0, k0, t1, k1): occurrences and different next characters by label; t0 or t1 is null where that model lacks the context.

    Contexts seen fewer than ``least_count`` times are left out. With
    ``max_contexts`` a model has only so many, the most frequent (ties: shorter
    first, then by character). A context's suffixes are at least as frequent
    and shorter, so they stay when it stays.
    """
    total = lambda n: F.when(F.sum(n) >= least_count, F.sum(n))
    own = grams.groupBy(_context().alias("context")).agg(
        total("n0").alias("t0"), F.count_if(F.col("n0") > 0).alias("k0"), total("n1").alias("t1"), F.count_if(F.col("n1") > 0).alias("k1")
    )
    for t in ("t0", "t1") if max_contexts is not None else ():
        top = own.filter(F.col(t).isNotNull()).orderBy(F.desc(t), F.length("context"), "context").limit(max_contexts)
        own = own.join(top.select("context", F.lit(True).alias("__top")), "context", "left").withColumn(t, F.when(F.col("__top"), F.col(t))).drop("__top")
    return own.filter("t0 is not null or t1 is not null")


def fit(labelled: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT, max_contexts: int | None = None) -> tuple[Model | None, Model | None]:
    """(accepted, rejected) models of ``labelled(url, label)``, label 0 or 1, on the driver; None for a label without URLs.

    For small models; :func:`filter_urls` leaves them where they are counted.
    """
    grams = written(gram_counts(labelled, order), "url-grams")
    placed = grams.withColumn("context", _context()).join(contexts_of(grams, least_count, max_contexts), "context")
    models = []
    for label in (0, 1):
        after: dict[str, dict[str, int]] = {}
        for r in placed.filter(f"t{label} is not null and n{label} > 0").select("context", "gram", F.col(f"n{label}").alias("n")).collect():
            after.setdefault(r.context, {})[r.gram[-1]] = r.n
        models.append(Model(order, after) if after else None)
    forget(grams)
    return models[0], models[1]


def window_scores(asked: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, s) of the distinct ``asked(window)``: log-probability of the last character after the others, rejected minus accepted."""
    wanted = asked.select(ends(F.col("window"), order).alias("gram")).distinct().withColumn("context", _context())
    known = written(wanted.join(contexts, "context", "left").join(grams, "gram", "left").drop("context").withColumn("size", F.length("gram")), "url-known")

    def smoothed(label: int, shorter: Column) -> Column:
        n, t, k = F.coalesce(f"n{label}", F.lit(0)), F.col(f"t{label}"), F.col(f"k{label}")
        return F.when(t.isNull(), shorter).otherwise((n + k * shorter) / (t + k)).alias(f"p{label}")

    level = None
    for size in range(1, order + 2):
        own = known.filter(F.col("size") == size)
        if level is None:
            shorter = [F.lit(1 / ALPHABET)] * 2
        else:
            own = own.join(level.select(F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), F.substring("gram", 2, order + 1) == F.col("end"))
            shorter = [F.col("q0"), F.col("q1")]
        level = own.select("gram", *(smoothed(label, shorter[label]) for label in (0, 1)))
    found = written(level.select(F.col("gram").alias("window"), (F.log("p1") - F.log("p0")).alias("s")), "url-window-scores")
    forget(known)
    return found


def scores(rows: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(rid, score) of ``rows(rid, url)``, URLs not empty; above 0 where the rejected model fits better.

    Where either model is empty nothing can be told apart and all scores are 0.
    """
    root = contexts.filter("context = ''").first()
    if root is None or root.t0 is None or root.t1 is None:
        return rows.select("rid", F.lit(0.0).alias("score"))
    flat = rows.select("rid", F.explode(windows(F.col("url"), order)).alias("window"))
    of_windows = window_scores(flat.select("window").distinct(), grams, contexts, order)
    found = written(flat.join(of_windows, "window").groupBy("rid").agg(F.avg("s").alias("score")), "url-scores")
    forget(of_windows)
    return found


def calibrated(held: DataFrame, false_rejects: float = FALSE_REJECTS, grid: float = 1e-3) -> float:
    """The smallest threshold, on a grid, above which at most ``false_rejects`` of ``held(score)``, accepted URLs, score.

    Without any it is 0. The histogram has as many rows as scores differ on the
    grid, whatever the number of URLs.
    """
    binned = held.groupBy(F.ceil(F.col("score") / grid).alias("bin")).count().collect()
    counts = {r.bin: r["count"] for r in binned if r.bin is not None}
    total, above = sum(counts.values()), 0
    threshold = max(counts, default=0)
    for place in sorted(counts, reverse=True):
        threshold = place
        above += counts[place]
        if above > false_rejects * total:
            break
    return max(threshold * grid, 0.0)


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str = "label", order: int = ORDER,
    least_count: int = LEAST_COUNT, max_contexts: int | None = None, false_rejects: float = FALSE_REJECTS, folds: int = FOLDS,
) -> DataFrame:
    """(page_id, url, score, accepted), one row for each input row.

    ``label_col``: 0 for URLs known to be accepted, 1 for rejected, null for
    the others; labelled URLs train, but for one fold of ``folds`` that only
    calibrates, and all are scored. A URL is accepted when its score is at most
    the calibrated threshold, which is never below 0. A null or empty URL has
    no score and is not accepted. Without URLs of both labels nothing can be
    told apart: scores are 0 and URLs accepted. Null ids and repeated rows pass
    through, long URLs are scored whole, an empty table gives no rows. Other
    columns are not looked at.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label"))
    rows = written(urls.withColumn("rid", F.monotonically_increasing_id()), "urls")
    full = rows.filter("url is not null and url <> ''")
    calibrates = held_out(F.col("url"), folds)
    grams = written(gram_counts(full.filter(F.col("label").isin(0, 1) & ~calibrates), order), "url-grams")
    contexts = written(contexts_of(grams, least_count, max_contexts), "url-contexts")
    own = scores(full, grams, contexts, order)
    threshold = calibrated(full.filter((F.col("label") == 0) & calibrates).join(own, "rid"), false_rejects)
    forget(grams, contexts)
    good = F.coalesce(F.col("score") <= threshold, F.lit(False))
    return rows.join(own, "rid", "left").select("page_id", "url", "score").withColumn("accepted", good)


def seeded(pages: DataFrame, url_col: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``pages`` with the column label: 1 where a part of the host is a seed word, else 0."""
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z]+://([^/?#]*)", 1)
    return pages.withColumn("label", F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*(F.lit(s) for s in seeds))).cast("int"))
