import numpy as np
import pytest

from glossator.llm import language_id

WORDS = {"en": "the and of with through would think reach".split(), "de": "und der über schön nicht großer weiß zwar".split(), "fr": "les où être garçon déjà voilà très quelque".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(360):
        lang = list(WORDS)[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang], int(rng.integers(3, 200)))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def net(docs):
    return language_id.fit(docs.filter("doc_id < 240"), steps=150)


def test_held_out_accuracy(docs, net):
    held = docs.filter("doc_id >= 240")
    found = language_id.accuracy(held, net)
    assert found[found.label == found.language]["count"].sum() >= 0.95 * 120


def test_network_against_a_plain_convolution(net):
    raw = np.frombuffer("über the garçon, und".encode() * 20, dtype=np.uint8)[: language_id.WINDOW]
    windows = np.stack([np.r_[raw, np.zeros(language_id.WINDOW - len(raw), np.uint8)], np.full(language_id.WINDOW, 97, np.uint8)])
    pooled = []
    for width, table in net.tables.items():
        conv = np.array([[sum(table[j][w[i + j]] for j in range(width)) for i in range(len(w) - width + 1)] for w in windows])
        pooled.append(np.maximum(conv.max(axis=1) + net.biases[width], 0))
    assert np.allclose(net.pooled(windows), np.concatenate(pooled, axis=1), atol=1e-4)
    assert np.allclose(net.probabilities(windows).sum(axis=1), 1)


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 255, 256, 257, 1000, 0]
    raw = rng.integers(1, 255, sum(sizes)).astype(np.uint8)
    offsets = np.r_[0, np.cumsum(sizes)]
    windows, row, held = language_id.cut(raw, offsets, 256)
    for i in range(len(sizes)):
        own = b"".join(w[:h].tobytes() for w, h in zip(windows[row == i], held[row == i]))
        assert own == raw[offsets[i] : offsets[i + 1]].tobytes()
    assert all((w[h:] == 0).all() for w, h in zip(windows, held))


def test_edge_cases(spark, net):
    rows = [(1, None), (2, ""), (None, "the and of with through would think"), (3, "und nicht " * 60_000), (4, "les très déjà voilà"), (4, "les très déjà voilà")]
    docs = spark.createDataFrame([(i, t, None, "x", 0.5, True) for i, t in rows], "doc_id long, text string, lang string, language string, confidence double, accepted boolean")
    got = language_id.identified(docs, net).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].language is None and by[2].language is None and not by[1].accepted and not by[2].accepted and by[1].confidence == 0
    assert (by[None].language, by[3].language, by[4].language) == ("en", "de", "fr")
    kept = language_id.keep_identified(docs, net)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 3, 4, 4], key=repr)
    assert {r.doc_id for r in language_id.keep_identified(docs, net, accepted=["de"]).collect()} == {3}
    assert language_id.identified(docs.limit(0), net).count() == 0
    none = language_id.fit(docs)
    assert none.languages == [] and all(r.language is None for r in language_id.identified(docs, none).collect())
    one = language_id.fit(docs.selectExpr("doc_id", "text", "'en' lang"))
    assert one.languages == ["en"]


def test_trains_on_the_smallest_hashes_and_on_repeats_once(spark, docs):
    from pyspark.sql import functions as F

    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("und nicht der").alias("text"), F.lit("de").alias("lang"))
    both = docs.unionByName(hot)
    keyed = both.select(F.xxhash64("doc_id", F.col("text").cast("binary")).alias("h"), F.col("lang").alias("label"))
    total = {"de": 3120, "en": 120, "fr": 120}
    by = {}
    for r in keyed.distinct().collect():
        by.setdefault(r.label, []).append(r.h)
    for wanted in (5, 100, 120, 500):
        got = language_id._edges(keyed, total, wanted)
        for label, hashes in by.items():
            assert sum(h <= got[label] for h in hashes) == min(wanted, len(hashes))


def test_no_rank_over_all_rows_of_a_label(docs):
    import inspect

    assert "row_number" not in inspect.getsource(language_id)


def test_score_is_the_mean_of_windows_by_their_bytes(spark, net):
    text = "the and of " * 40 + "über schön " * 3
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    windows, _, held = language_id.cut(raw, np.array([0, len(raw)]))
    mean = (net.probabilities(windows) * held[:, None]).sum(0) / len(raw)
    got = language_id.identified(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert (got.language, got.confidence) == (net.languages[int(mean.argmax())], pytest.approx(float(mean.max()), rel=1e-6))


def test_gradients_lower_the_loss_and_ties_go_to_the_first(spark):
    zero = language_id.ByteCNN(["b", "c"], {2: np.zeros((2, 256, 2), np.float32)}, {2: np.zeros(2, np.float32)}, np.zeros((2, 2), np.float32), np.zeros(2, np.float32))
    got = language_id.identified(spark.createDataFrame([(1, "any text")], "doc_id long, text string"), zero).first()
    assert (got.language, got.confidence, got.accepted) == ("b", 0.5, True)
    rng = np.random.default_rng(2)
    windows = rng.integers(97, 100, (60, 32)).astype(np.uint8)
    labels = (windows[:, 3] == 97).astype(np.int64)
    windows[labels == 1, 5] = 120
    loss = lambda n: -np.log(n.probabilities(windows)[np.arange(60), labels]).mean()
    assert loss(language_id.train(windows, labels, ["a", "b"], steps=120)) < 0.3 * loss(language_id.train(windows, labels, ["a", "b"], steps=1))


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs.filter("doc_id % 2 = 0"))
    found = language_id.accuracy(docs.filter("doc_id % 2 = 1"), net)
    assert found[found.label == found.language]["count"].sum() >= 0.95 * found["count"].sum()
