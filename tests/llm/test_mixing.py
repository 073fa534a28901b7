import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        source = "abc"[int(rng.choice(3, p=[0.7, 0.2, 0.1]))]
        lang = "xy"[int(rng.choice(2, p=[0.8, 0.2] if source == "a" else [0.4, 0.6]))]
        rows.append((i, "w " * int(rng.integers(1, 60)), source, lang, "z"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string").repartition(3)


def _raked(cells, wanted, margin, budget):
    """Iterative proportional fitting: the same optimum, found by another method."""
    w = dict(cells)
    for _ in range(4000):
        for key, goal in ((0, wanted), (1, margin)):
            for g, share in goal.items():
                own = sum(v for k, v in w.items() if k[key] == g)
                w = {k: v * share * budget / own if k[key] == g else v for k, v in w.items()}
    return {k: w[k] / cells[k] for k in cells}


@pytest.mark.parametrize("targets", [None, {"a": 0.2, "b": 0.5, "c": 0.3}])
def test_rates_against_proportional_fitting(corpus, targets):
    out = mixing.rates(corpus, targets=targets, budget_ratio=1.5)
    rows = out.collect()
    assert len(rows) == corpus.count()
    cells, got = {}, {}
    for r in rows:
        cells[r.source, r.margin] = cells.get((r.source, r.margin), 0) + r.tokens
        got[r.source, r.margin] = r.rate
    total = sum(cells.values())
    own = {s: sum(v for k, v in cells.items() if k[0] == s) for s in "abc"}
    raised = {s: v**mixing.TEMPERATURE for s, v in own.items()}
    wanted = targets or {s: v / sum(raised.values()) for s, v in raised.items()}
    margin = {m: sum(v for k, v in cells.items() if k[1] == m) / total for m in "xy"}
    want = _raked(cells, wanted, margin, 1.5 * total)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-5)
    for s in "abc":
        assert sum(r.tokens * r.rate for r in rows if r.source == s) == pytest.approx(wanted[s] * 1.5 * total, rel=1e-6)
        assert sum(r.tokens * r.copies for r in rows if r.source == s) == pytest.approx(wanted[s] * 1.5 * total, rel=0.08)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_mixed_repeats_rows_by_their_copies(corpus):
    copies = {r.doc_id: r.copies for r in mixing.rates(corpus).collect()}
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    seen = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert seen == {i: n for i, n in copies.items() if n}


def test_edge_cases(spark, corpus):
    rows = [(1, "a b", "s", None), (2, None, "s", "x"), (3, "", "s", "x"), (4, "a", None, "x"), (None, "a b c", "t", "x"), (5, " \n", "u", "x"), (5, "a", "s", "x"), (5, "a", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.rates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.rate == 0 and r.copies == 0 for r in got if r.tokens == 0)
    assert all(r.rate > 0 for r in got if r.tokens)
    assert mixing.mixed(docs).columns == docs.columns
    only = mixing.rates(docs, targets={"t": 1.0, "absent": 1.0}).collect()
    assert {r.source for r in only if r.rate > 0} == {"t"}
    assert mixing.rates(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.filter("doc_id = 2")).count() == 0


def test_unmeetable_margins_end(spark):
    docs = spark.createDataFrame([(1, "a " * 90, "s", "x"), (2, "a " * 10, "t", "y")], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.rate for r in mixing.rates(docs, targets={"s": 0.5, "t": 0.5}).collect()}
    assert got == {1: pytest.approx(50 / 90), 2: pytest.approx(5.0)}


def test_rare_combinations_meet_their_rates_by_a_join(corpus):
    whole = sorted((r.doc_id, r.copies, round(r.rate, 9)) for r in mixing.rates(corpus).collect())
    for hot in (0, 2, 4):
        assert sorted((r.doc_id, r.copies, round(r.rate, 9)) for r in mixing.rates(corpus, hot=hot).collect()) == whole
        assert mixing.mixed(corpus, hot=hot).count() == sum(c for _, c, _ in whole)


def test_more_than_twenty_thousand_sources(spark):
    rows = spark.range(42_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.concat(F.lit("host-"), (F.col("id") % 21_000)).alias("source"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    out = mixing.rates(rows)
    got = {r.lang: r.t for r in out.groupBy(F.col("margin").alias("lang")).agg(F.sum(F.col("tokens") * F.col("rate")).alias("t")).collect()}
    own = {r.lang: r.t for r in out.groupBy(F.col("margin").alias("lang")).agg(F.sum("tokens").alias("t")).collect()}
    assert got == {k: pytest.approx(v, rel=1e-6) for k, v in own.items()}
    assert out.filter("rate > 0").select("source").distinct().count() == 21_000


@pytest.mark.parametrize("margins", [3, 9])
def test_conjugate_gradients_take_the_same_step(spark, margins):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):
        js = sorted(rng.choice(margins, int(rng.integers(1, margins + 1)), replace=False).tolist())
        rows.append((float(rng.random() + 0.1), js, [float(x) for x in rng.random(len(js)) + 0.05]))
    total = sum(r[0] for r in rows)
    table = spark.createDataFrame([(g / total, j, t) for g, j, t in rows], "goal double, js array<int>, ts array<double>")
    shares = np.zeros(margins)
    for g, js, ts in rows:
        for j, t in zip(js, ts):
            shares[j] += g / total * t * (1 + 0.3 * j) / sum(u * (1 + 0.3 * k) for k, u in zip(js, ts))
    a, b = mixing.solve(table, shares), mixing.solve(table, shares, dense=0)
    assert np.allclose(a - a[0], b - b[0], atol=1e-5)
    assert np.allclose(a - a[0], np.log((1 + 0.3 * np.arange(margins))), atol=1e-5)
