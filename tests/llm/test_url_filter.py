import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossator.llm import url_filter


def _brute_model(urls, order):
    counts = defaultdict(Counter)
    for u in urls:
        padded = url_filter.START * order + u + url_filter.END
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1
    return counts


def _brute_log(counts, past, char, least):
    p = 1 / url_filter.ALPHABET
    for k in range(len(past) + 1):
        own = counts.get(past[len(past) - k :])
        if own is None or sum(own.values()) < least:
            break
        p = (own[char] + len(own) * p) / (sum(own.values()) + len(own))
    return math.log(p)


@pytest.fixture(scope="module")
def rows():
    good = [f"https://{w}.example.com/{n}" for n, w in enumerate(["garden", "library", "weather", "kitchen", "é-museum"] * 12)]
    bad = [f"http://{w}.example.net/win?{n}" for n, w in enumerate(["casino", "cheap-pills", "free-bets"] * 12)]
    return [(i, u, int(i >= len(good))) for i, u in enumerate(good + bad)]


def test_scores_and_threshold_against_brute_force(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, label int").repartition(3)
    order = 3
    held = {r.url for r in pages.filter(url_filter.held_out(F.col("url"))).collect()}
    models = [_brute_model([u for _, u, l in rows if l == k and u not in held], order) for k in (0, 1)]
    want = {}
    for i, u, _ in rows:
        padded = url_filter.START * order + u + url_filter.END
        each = [_brute_log(models[1], padded[j - order : j], padded[j], 2) - _brute_log(models[0], padded[j - order : j], padded[j], 2) for j in range(order, len(padded))]
        want[i] = sum(each) / len(each)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, order=order).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want)
    bins = sorted(math.ceil(want[i] / 1e-3) for i, u, l in rows if l == 0 and u in held)
    threshold = max(bins[-1] * 1e-3, 0)  # one of a few would be more than 1 %
    assert {i for i, r in got.items() if r.accepted} == {i for i, s in want.items() if s <= threshold}
    right = sum(got[i].accepted == (l == 0) for i, u, l in rows if u in held)
    assert right >= 0.9 * len([1 for _, u, _ in rows if u in held])


def test_a_smaller_tree_backs_off(spark, rows):
    urls = spark.createDataFrame(rows, "page_id long, url string, label int").select("url", "label")
    accepted, _ = url_filter.fit(urls, 4, 2, 40)
    assert len(accepted.after) == 40
    for context in accepted.after:
        assert context[1:] in accepted.after
    assert accepted.log_probability("zzzz?") < 0
    total = sum(math.exp(accepted.log_probability("xxxx" + c)) for c in map(chr, range(url_filter.ALPHABET)))
    assert total == pytest.approx(1, abs=0.02)


def test_edge_cases(spark, rows):
    odd = [(1000, None, 0), (1001, "", 1), (None, "http://casino.example.net/" + "a" * 50_000, None), (1002, "http://x", None), (1002, "http://x", None)]
    pages = spark.createDataFrame([(*r, "s", 1.0, True) for r in rows + odd], "page_id long, url string, label int, window string, score double, accepted boolean")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.page_id: r for r in got}
    assert by[1000].score is None and not by[1000].accepted and by[1001].score is None and not by[1001].accepted
    assert by[None].score is not None and sum(r.page_id == 1002 for r in got) == 2
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    one = url_filter.filter_urls(pages.filter("label = 0 and url is not null")).collect()
    assert all(r.accepted and r.score == 0 for r in one)


def test_seeds(spark):
    urls = ["https://www.Casino-win.example.com/a", "https://casinos.example.com/pills", "https://a.pills", None]
    got = url_filter.seeded(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [r.label for r in got] == [1, 0, 1, None]


def test_contexts_beyond_any_number_are_kept(spark):
    draw = random.Random(3)
    urls = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(3000)]
    rows = [(i, u, int(i % 4 == 0)) for i, u in enumerate(urls + urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int").repartition(3)
    held = {r.url for r in pages.filter(url_filter.held_out(F.col("url"))).collect()}
    models = [_brute_model([u for _, u, l in rows if l == k and u not in held], 5) for k in (0, 1)]
    assert sum(sum(own.values()) >= 2 for own in models[0].values()) > 60_000
    got = {r.page_id: r.score for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows[::50]:
        padded = url_filter.START * 5 + u + url_filter.END
        each = [_brute_log(models[1], padded[j - 5 : j], padded[j], 2) - _brute_log(models[0], padded[j - 5 : j], padded[j], 2) for j in range(5, len(padded))]
        assert got[i] == pytest.approx(sum(each) / len(each))
