"""Mixing sources to target weights by entropy balancing.

Documents receive rates, their expected numbers of copies. Among all rates
whose tokens meet the constraints, entropy balancing takes those nearest to 1
in token-weighted relative entropy. The solution tilts documents
exponentially, ``rate = exp(lambda . x)`` with ``x`` a document's constraint
indicators, and ``lambda`` minimises a convex dual,

    sum_i tokens_i * exp(lambda . x_i) - lambda . target,

which Newton's method solves. For given margin multipliers a source's own
multiplier is known, since its tokens must meet its target, so Newton runs on
the margin multipliers alone: their Hessian is the Schur complement of the
whole one. Each step is a distributed aggregation over the sources, one row
each, which returns the dual, the gradient and the Hessian, or with many
margins the Hessian's product with a vector (conjugate gradients). The driver
holds one number for each margin and nothing for sources. Rates are rounded to
copies by a hash of the id, without bias.

Sources meet target shares of the tokens; a margin (by default the language)
keeps the share that it has, so that shifting sources doesn't shift it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

TEMPERATURE = 0.5
#: Up to so many margins the Hessian is made whole; beyond, conjugate gradients only use its products. The result is the same.
DENSE = 64
#: Combinations of source and margin whose rates are broadcast, the most frequent ones (40 bytes each); the others meet their rates by a join.
HOT = 262_144
RIDGE = 1e-10


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def _goals(cells: DataFrame, targets: dict | None, temperature: float) -> DataFrame:
    """(source, goal): target shares of the sources that have tokens; they add up to 1.

    Without ``targets`` they are proportional to the sources' own tokens raised
    to ``temperature``.
    """
    own = cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("t"))
    if targets is None:
        raised = own.select("source", F.pow("t", F.lit(float(temperature))).alias("goal"))
    else:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items() if v > 0], "s string, goal double")
        raised = own.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("source", "goal")
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("goal").alias("all")))).select("source", (F.col("goal") / F.col("all")).alias("goal"))


def _terms(mu: np.ndarray, part):
    """A function over batches of (goal, js, ts), one row a source: (k, v) sums of what ``part`` returns for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                own = batch.slice(lo, 1024)
                goal, js, ts = np.asarray(own.column("goal")), own.column("js"), own.column("ts")
                row = np.repeat(np.arange(len(goal)), np.asarray(js.value_lengths()))
                j, x = np.asarray(js.flatten()), np.log(np.asarray(ts.flatten()))
                x = x + mu[j]
                begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                top = np.maximum.reduceat(x, begin)
                e = np.exp(x - top[row])
                norm = np.add.reduceat(e, begin)
                for k, v in part(goal, row, j, e / norm[row], top + np.log(norm)):
                    for key, value in zip(np.atleast_1d(k).tolist(), np.atleast_1d(v).tolist()):
                        total[key] = total.get(key, 0.0) + value
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["k", "v"])

    return run


def _summed(rows: DataFrame, mu: np.ndarray, part) -> dict[int, float]:
    found = rows.select("goal", "js", "ts").mapInArrow(_terms(mu, part), "k long, v double")
    return {r.k: r.v for r in found.groupBy("k").agg(F.sum("v").alias("v")).collect()}


def _descended(rows: DataFrame, mu: np.ndarray, hessian: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Dual, gradient and Hessian, without the part that is linear in ``mu``."""
    m = len(mu)

    def part(goal, row, j, p, level):
        yield -1, float((goal * level).sum())
        held, at = np.unique(j, return_inverse=True)
        weight = np.bincount(at, weights=goal[row] * p)
        yield held, weight
        if hessian:
            flat = np.zeros((len(goal), len(held)))
            flat[row, at] = p
            whole = np.diag(weight) - (flat * goal[:, None]).T @ flat
            yield (m + held[:, None] * m + held[None]).ravel(), whole.ravel()

    got = _summed(rows, mu, part)
    of = lambda lo, n: np.array([got.get(k, 0.0) for k in range(lo, lo + n)])
    return got.get(-1, 0.0), of(0, m), of(m, m * m).reshape(m, m) if hessian else None


def _product(rows: DataFrame, mu: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The Hessian's product with ``v``."""

    def part(goal, row, j, p, level):
        mean = np.bincount(row, weights=p * v[j], minlength=len(goal))
        held, at = np.unique(j, return_inverse=True)
        yield held, np.bincount(at, weights=goal[row] * p * (v[j] - mean[row]))

    got = _summed(rows, mu, part)
    return np.array([got.get(k, 0.0) for k in range(len(mu))])


def _conjugate(times, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The solution of ``times(x) = b`` by conjugate gradients, scaled by ``weight``."""
    scale = 1 / np.maximum(weight, 1e-12)
    x, r = np.zeros_like(b), b.copy()
    z = scale * r
    p, old = z.copy(), float(r @ z)
    for _ in range(len(b)):
        if np.abs(r).max() < 1e-10 * max(np.abs(b).max(), 1e-300):
            break
        step = times(p)
        size = old / max(float(p @ step), 1e-300)
        x, r = x + size * p, r - size * step
        z = scale * r
        new = float(r @ z)
        p, old = z + new / old * p, new
    return x


def solve(rows: DataFrame, shares: np.ndarray, tolerance: float = 1e-9, most_steps: int = 100, dense: int = DENSE) -> np.ndarray:
    """Margin multipliers, by Newton iterations on the dual.

    ``rows``: (goal, js, ts), one row a source: its target share, and the
    margins that it has with their tokens. ``shares``: the margins' targets. A
    margin that the sources cannot meet is met as nearly as they can.
    """
    m = len(shares)
    mu = np.zeros(m)
    whole = m <= dense
    dual = lambda value, at: value - float(at @ shares) + 0.5 * RIDGE * float(at @ at)
    value, weight, hessian = _descended(rows, mu, whole)
    value, before = dual(value, mu), None
    for _ in range(most_steps):
        gradient = weight - shares + RIDGE * mu
        # Where nothing moves any more the rest cannot be met.
        if np.abs(gradient).max() < tolerance or (before is not None and np.abs(gradient - before).max() < tolerance):
            break
        if whole:
            step = np.linalg.solve(hessian + RIDGE * np.eye(m), -gradient)
        else:
            step = _conjugate(lambda v: _product(rows, mu, v) + RIDGE * v, -gradient, weight)  # noqa: B023
        size, slope = min(1.0, 8.0 / max(np.abs(step).max(), 1e-300)), float(gradient @ step)
        while True:
            trial = mu + size * step
            new_value, new_weight, new_hessian = _descended(rows, trial, whole)
            new_value = dual(new_value, trial)
            if new_value <= value + 1e-4 * size * slope + 1e-15 or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:
            break
        before, mu, value, weight, hessian = gradient, trial, new_value, new_weight, new_hessian
    return mu


def _key(source: Column, margin: Column) -> list[Column]:
    """Two hashes of a combination; they stand for it where rates are looked up."""
    parts = (source.isNull(), F.coalesce(source, F.lit("")), margin.isNull(), F.coalesce(margin, F.lit("")))
    return [F.xxhash64(*parts, F.lit(n)) for n in (1, 2)]


def cell_rates(counted: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, budget_ratio: float = 1.0, dense: int = DENSE) -> DataFrame:
    """(k1, k2, n, rate) of each combination that is drawn from, stored; ``counted``: (source, margin, tokens, n)."""
    spark = counted.sparkSession
    cells = written(counted.filter("tokens > 0").groupBy("source", "margin").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")), "cells")
    keys = [k.alias(n) for k, n in zip(_key(F.col("source"), F.col("margin")), ("k1", "k2"))]
    there = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.count_distinct(*keys).alias("d")).first()
    if there.n != there.d:
        raise ValueError("hashes of two combinations of source and margin are equal")
    budget = (there.tokens or 0) * budget_ratio
    goals = _goals(cells, targets, temperature).select(F.col("source").alias("gs"), "goal")
    drawn = written(cells.join(goals, F.col("source").eqNullSafe(F.col("gs"))).drop("gs"), "drawn-cells")
    by_margin = sorted(((r.margin, r.t) for r in drawn.groupBy("margin").agg(F.sum("tokens").alias("t")).collect()), key=repr)
    if not by_margin or budget <= 0:
        return spark.createDataFrame([], "k1 long, k2 long, n long, rate double")
    shares = np.array([float(t) for _, t in by_margin])
    places = spark.createDataFrame([(k, n) for n, (k, _) in enumerate(by_margin)], "gm string, j int")
    placed = drawn.join(places, F.col("margin").eqNullSafe(F.col("gm"))).drop("gm")
    rows = written(
        placed.groupBy("source").agg(F.first("goal").alias("goal"), F.sort_array(F.collect_list(F.struct("j", (F.col("tokens") / budget).alias("t"), "n", "margin"))).alias("c")).select("source", "goal", F.col("c.j").alias("js"), F.col("c.t").alias("ts"), "c"),
        "source-rows",
    )
    mu = solve(rows, shares / shares.sum(), dense=dense)

    def tilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            if batch.num_rows:
                next(_terms(mu, lambda goal, row, j, p, level: out.append(goal[row] * p) or ())(iter([batch])))
                goal, js, ts = (batch.column(c) for c in ("goal", "js", "ts"))
                # Slices of the batch were taken in order.
                rate = np.concatenate(out) / np.asarray(ts.flatten())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.asarray(js.value_lengths()))].astype(np.int32)), pa.array(rate))
                yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("margins"), batch.column("ns"), lists], names=["source", "margins", "ns", "rates"])

    flat = rows.select("source", "goal", "js", "ts", F.col("c.margin").alias("margins"), F.col("c.n").alias("ns")).mapInArrow(tilt, "source string, margins array<string>, ns array<long>, rates array<double>")
    each = flat.select("source", F.explode(F.arrays_zip("margins", "ns", "rates")).alias("x")).select("source", F.col("x.margins").alias("margin"), F.col("x.ns").alias("n"), F.col("x.rates").alias("rate"))
    found = written(each.select(*keys, "n", "rate"), "cell-rates")
    forget(cells, drawn, rows)
    return found


def with_rates(rows: DataFrame, source: Column, margin: Column, cells: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` with the column ``__rate``, 0 where nothing is drawn; frequent combinations never shuffle their rows."""
    sizes = {r.b: r["count"] for r in cells.groupBy(F.floor(F.log2(F.col("n"))).alias("b")).count().collect()}
    room, edge = hot, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            break
        edge = b
    k1, k2 = _key(source, margin)
    keyed = rows.withColumns({"__k1": k1, "__k2": k2})
    frequent = F.floor(F.log2(F.col("n"))) >= edge
    top = cells.filter(frequent).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("rate").alias("__rate"))
    met = keyed.join(F.broadcast(top), ["__k1", "__k2"], "left")
    if any(b < edge for b in sizes):
        rest = cells.filter(~frequent).select(F.col("k1").alias("__r1"), F.col("k2").alias("__r2"), F.col("rate").alias("__rest"))
        # Rows that have their rate are spread over the shuffle instead of meeting at their key.
        spread = F.when(F.col("__rate").isNull(), F.col("__k1")).otherwise(F.xxhash64("__k1", F.monotonically_increasing_id()))
        met = met.withColumn("__s", spread)
        met = met.join(rest, (met["__s"] == rest["__r1"]) & (met["__k2"] == rest["__r2"]), "left").withColumn("__rate", F.coalesce("__rate", "__rest")).drop("__s", "__r1", "__r2", "__rest")
    return met.withColumn("__rate", F.coalesce("__rate", F.lit(0.0))).drop("__k1", "__k2")


def rates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", margin_col: str | None = "lang",
    targets: dict | None = None, temperature: float = TEMPERATURE, budget_ratio: float = 1.0, seed: int = 7, hot: int = HOT,
) -> DataFrame:
    """(doc_id, source, margin, tokens, rate, copies), one row for each input row.

    ``targets``: share of the tokens by source; without it the sources' own
    shares flattened by ``temperature``. A source that has no tokens cannot be
    drawn from: its share goes to the others. A source without a target gets
    rate 0. ``budget_ratio``: tokens wanted over tokens there are.

    A null source, and a null margin, is a group of its own. A null or empty
    text has no tokens: rate and copies are 0, as it adds nothing to a mixture.
    The rounding hashes the id (null ids hash alike) and the position among
    repeated rows doesn't matter: rows with the same id get the same copies if
    their rates are the same. Very long texts count whole. Sources always meet
    their targets; margins that they cannot meet are met as nearly as they can.
    There is no limit on the number of sources; margins are one number each on
    the driver. An empty table gives no rows. Other columns are not looked at.
    """
    margin = F.col(margin_col).cast("string") if margin_col else F.lit("all")
    counted = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), margin.alias("margin"), token_count(F.col(text_col).cast("string")).alias("tokens")),
        "token-counts",
    )
    cells = cell_rates(counted.withColumn("n", F.lit(1).cast("long")), targets, temperature, budget_ratio)
    rated = with_rates(counted, F.col("source"), F.col("margin"), cells, hot)
    rate = F.when(F.col("tokens") > 0, F.col("__rate")).otherwise(F.lit(0.0))
    return rated.withColumn("rate", rate).withColumn("copies", _copies(F.col("rate"), F.col("doc_id"), seed)).select(*counted.columns, "rate", "copies")


def _copies(rate, doc_id, seed):
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.floor(rate + draw).cast("int")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", margin_col: str | None = "lang",
    targets: dict | None = None, temperature: float = TEMPERATURE, budget_ratio: float = 1.0, seed: int = 7, hot: int = HOT,
) -> DataFrame:
    """``docs`` with each row repeated as often as its copies say, all columns kept (see :func:`rates`).

    Rows of the ``hot`` most frequent combinations of source and margin are
    judged where they are read; only those of rarer ones are shuffled.
    """
    names = docs.columns
    private = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {n: f"__c{i}" for i, n in enumerate(names)}
    source, margin = F.col(at[source_col]).cast("string"), F.col(at[margin_col]).cast("string") if margin_col else F.lit("all")
    plain = private.select(source.alias("source"), margin.alias("margin"), token_count(F.col(at[text_col]).cast("string")).alias("tokens"))
    counted = written(plain.groupBy("source", "margin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "cell-tokens")
    placed = with_rates(private, source, margin, cell_rates(counted, targets, temperature, budget_ratio), hot)
    forget(counted)
    some = F.col(at[text_col]).cast("string").rlike(r"[^\s]")
    copies = F.when(some, _copies(F.col("__rate"), F.col(at[id_col]), seed)).otherwise(F.lit(0))
    out = placed.withColumn("__n", copies).filter("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select(*private.columns).toDF(*names)
