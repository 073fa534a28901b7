"""Kernels on Arrow buffers against the column functions that they stand for, and the plans that use them."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossator.functions.arrays import pieces, tokens
from glossator.functions.text import WORD_OR_SIGN, char_grams, char_ngrams
from glossator.operators import contamination, phrases, probe, similarity, spans

TEXTS = ["Hello wörld ß Straße", "", None, "日本語テキスト🙂🙂 abc", "ab", "aaaaaaaaaaaa", "ﬃ ligature é è ï", "x" * 50, "the cat sat on the mat. The cat"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_gram_counts_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr("glossator.functions.arrays.PIECE_BYTES", 40)
    df = _table(spark)
    found = probe.gram_counts(df, "doc_id", "text")
    assert "Exchange" not in _plan(found)
    want = df.select("doc_id", F.explode(char_grams("text")).alias("bucket")).groupBy("doc_id", "bucket").agg(F.count("*").alias("cnt"))
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    low = TEXTS[3].casefold()
    plain = Counter(zlib.crc32(low[i : i + w].encode()) & ((1 << 18) - 1) for w in (3, 4, 5) for i in range(len(low) - w + 1))
    assert {r.bucket: r.cnt for r in found.collect() if r.doc_id == 3} == plain


def test_gram_counts_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "xabc"), (None, "abc"), (None, "abc"), (2, "abc")], "doc_id int, text string")
    want = df.select("doc_id", F.explode(char_grams("text")).alias("bucket")).groupBy("doc_id", "bucket").agg(F.count("*").alias("cnt"))
    assert Counter(map(tuple, probe.gram_counts(df, "doc_id", "text").collect())) == Counter(map(tuple, want.collect()))


def test_tokens_against_the_pattern(monkeypatch):
    monkeypatch.setattr("glossator.functions.arrays.PIECE_BYTES", 40)
    texts = [*TEXTS, "a_1 b--c\u00a0d\u2003e\x1cf", "x\u0301y 12.5 \U0001d7d8 ...", "  ", "end"]
    got = {k: [] for k in range(len(texts))}
    for column in (pa.array(texts), pa.array(["skipped", *texts])[1:]):
        got = {k: [] for k in range(len(texts))}
        for lo, _, raw, at in pieces(column):
            for r, s, e, t in zip(*tokens(raw, at)):
                got[lo + int(r)].append((int(s), int(e), t.as_py()))
        assert got == {k: [(*m.span(), m.group()) for m in re.finditer(WORD_OR_SIGN, t or "")] for k, t in enumerate(texts)}
    assert [len(np.concatenate([x[0] for x in [tokens(raw, at)]])) for _, _, raw, at in pieces(pa.array([None, ""], pa.string()))] == [0]


def test_spans_are_retold_where_the_tags_are_made(spark):
    mark = lambda *x: [dict(zip(("entity_type", "start", "end", "text"), a)) for a in x]
    rows = [
        ("a", "train", "call AB-12 or CD-34 now", mark(("CODE", 5, 10, "AB-12"), ("CODE", 14, 19, "CD-34"))),
        ("b", "train", "AB12 AB12x end", mark(("CODE", 0, 4, "AB12"), ("CODE", 5, 9, "AB12"), ("TAIL", 11, 14, "end"))),
        ("c", "eval", "one two three", mark(("X", 0, 3, "one"), ("Y", 4, 13, "two three"))),
        ("d", "eval", "one two", mark(("X", 0, 7, "one two"), ("Y", 4, 7, "two"))),
        ("e", "eval", " é two", mark(("X", 0, 6, " é two"))),
        ("f", "eval", None, mark(("X", 0, 3, "one"))), ("g", "eval", "plain", []), ("h", "eval", "plain", None), ("i", "eval", "xy", mark(("X", 1, 2, "y"), (None, 0, 1, "x"), ("Z", 2, None, ""))),
    ]
    rec = spark.createDataFrame(rows, "case_id string, split string, text string, annotations array<struct<entity_type: string, start: int, end: int, text: string>>")
    found = spans.retold(rec)
    assert "Exchange" not in _plan(found)
    tags = spans.tagged(rec).withColumn("tag", F.coalesce("tag", F.lit("O")))
    place = {(r.case_id, r.pos): (r.start, r.end) for r in tags.collect()}
    want = {(r.case_id, r.span_no, r.label, place[r.case_id, r.first_pos][0], place[r.case_id, r.last_pos][1]) for r in spans.decoded(tags, ["case_id"]).collect()}
    assert {tuple(r) for r in found.collect()} == want
    assert len(want) == 8, sorted(want)


def test_features_are_those_of_the_hashing_stages(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF, Normalizer

    monkeypatch.setattr("glossator.functions.arrays.PIECE_BYTES", 40)
    df = _table(spark).filter("text is not null")
    found = probe.features(df, dimension=1 << 18)
    assert "MapInArrow" in _plan(found) and "transform(" not in _plan(found.select("features"))[:20000].split("MapInArrow")[0]
    hashed = HashingTF(inputCol="g", outputCol="tf", numFeatures=1 << 18).transform(df.withColumn("g", char_ngrams("text")))
    want = Normalizer(inputCol="tf", outputCol="features", p=2.0).transform(hashed)
    assert {r.doc_id: r.features for r in found.collect()} == {r.doc_id: r.features for r in want.collect()}


def test_probe_makes_its_examples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def visit(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("train" if i % 3 else "eval", f"{'good' if i % 2 else 'bad'} words number {i}", "a" if i % 2 else "b") for i in range(48)]
    examples = spark.createDataFrame(rows, "split string, text string, target string").mapInArrow(visit, "split string, text string, target string")
    found, why = probe.probe(examples, iterations=3)
    assert why is None and [r.split for r in found] == ["eval"]
    assert seen.value == 48


def test_copies_make_no_squares(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(i, words) for i in range(40)] + [(100 + i, words + " more") for i in range(30)] + [(200, "quite another text is this one"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    classes, pairs = similarity.near_classes(df, "id", "t", 0.85)
    assert [(r.l, r.r, r.both, r.total) for r in pairs.collect()] == [(0, 100, 57, 58)]
    assert {(r.rep, r.copies) for r in classes.collect()} == {(0, 40), (100, 30), (200, 1)}
    links = similarity.near_links(df, "id", "t", 0.85).collect()
    assert len(links) == 1 + 39 + 29
    assert {(r.l, r.r) for r in links} == {(0, 100)} | {(0, i) for i in range(1, 40)} | {(100, 100 + i) for i in range(1, 30)}
    records = df.select("id", "t", F.lit("").alias("split"))
    (got,) = contamination.redundancy(records, classes, pairs).collect()
    assert tuple(got) == ("", 70, 70 * 69 // 2, 73)
    assert similarity.near_pairs(df, "id", "t", 0.85).count() == 70 * 69 // 2


def test_sets_that_share_a_hash_are_compared(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v", "a b c d e f g h i j k l m n o p q r s t u v w", "other words in here are all new", "yet another row of plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    plain = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda d, label: plain(d.withColumn("k", F.lit(7).cast("long")) if label == "shingle-sets" else d, label))
    _, pairs = similarity.near_classes(df, "id", "t", 0.85)
    assert [(r.l, r.r) for r in pairs.collect()] == [(0, 1)]


def test_containment_sends_no_shingle_to_python(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:14]))], "doc_id long, text string")
    found = similarity.containment(items, "item_id", "text", docs, "doc_id", "text")
    assert "InArrow" not in _plan(found)
    assert {tuple(r) for r in found.select("item", "doc", "both", "total").collect()} == {(1, 1, 17, 17), (2, 1, 17, 17), (1, 2, 11, 17)}


def test_tags_without_the_split(spark):
    rec = spark.createDataFrame([("a", "train", "call AB-12", [("CODE", 5, 10, "AB-12")])], "case_id string, split string, text string, annotations array<struct<entity_type: string, start: int, end: int, text: string>>")
    assert spans.tagged(rec, with_split=False).collect() == spans.tagged(rec).drop("split").collect()


def _marked(spark):
    texts = ["the cat sat on the mat", "the cat sat on a <b c> mat the cat", "a dog <x>", "", None, "the cat sat on the mat again", "zz yy xx ww vv", "the cat sat on no mat", "on the mat the cat sat on"] * 2
    rows = [(t, None if k == 11 else k % 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "t string, c int").repartition(3)


def test_markers_are_counted_by_hash(spark, monkeypatch):
    df, tokens = _marked(spark), phrases.marker_tokens(F.col("t"))
    want = phrases.gram_counts(df, tokens, "c")
    want = want.groupBy("feature", "width").agg(F.sum("n").alias("support"), F.min(F.struct((-F.col("n")).alias("n"), "class")).alias("b")).filter("support >= 3 and b.class is not null")
    want = {(r.feature, r.width, r.b["class"], -r.b.n, r.support) for r in want.collect()}
    plain = phrases.gram_counts
    monkeypatch.setattr(phrases, "gram_counts", None)
    monkeypatch.setattr(phrases, "RUN_TOKENS", 10)
    assert {tuple(r)[:5] for r in phrases.class_markers(df, tokens, "c", 3).collect()} == want
    assert len(want) > 10
    monkeypatch.setattr(phrases, "gram_counts", plain)
    monkeypatch.setattr(phrases, "HELD_GRAMS", 2)
    assert {tuple(r)[:5] for r in phrases.class_markers(df, tokens, "c", 3).collect()} == want


def test_most_pervasive_by_hash(spark, monkeypatch):
    df = _marked(spark)
    for limit in (1, 3, 200):
        want = phrases.pervasive(df, F.col("t")).orderBy(F.desc("df"), "gram").limit(limit).collect()
        assert phrases.most_pervasive(df, F.col("t"), limit).collect() == want


def test_ngrams_that_share_a_hash_are_told_apart(spark, monkeypatch):
    df, tokens = _marked(spark), phrases.marker_tokens(F.col("t"))
    hashes = np.array([r.h for r in phrases.hash_counts(df, tokens, F.lit(""), (1, 2), True).collect()])
    assert phrases.hash_names(df, tokens, hashes, (1, 2), True) is not None
    want = {tuple(r) for r in phrases.class_markers(df, tokens, "c", 3).collect()}
    real = phrases._grams

    def coarse(flat, first, widths, plain, base):
        for w, place, h in real(flat, first, widths, plain, base):
            yield w, place, h % 3 if base == phrases.BASES[0] else h

    monkeypatch.setattr(phrases, "_grams", coarse)
    few = np.array([0, 1, 2])
    assert phrases.hash_names(df, tokens, few, (1, 2), True) is None
    assert {tuple(r) for r in phrases.class_markers(df, tokens, "c", 3).collect()} == want


def test_candidates_are_compared_in_cells(spark, monkeypatch):
    import random

    draw = random.Random(5)
    texts = []
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(60)]
        for _ in range(12):
            own = list(base)
            for _ in range(draw.randint(0, 2)):
                own[draw.randint(0, 59)] = f"x{draw.randint(0, 9)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame([(f"d{i:03}", t, "ab"[i % 2]) for i, t in enumerate(texts)], "id string, t string, s string").repartition(3)
    sets = [{" ".join(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    want = {("ab"[i % 2], f"d{i:03}", f"d{j:03}", len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i + 2, len(texts), 2) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    assert len(want) > 50
    for size in (2048, 2):
        monkeypatch.setattr(similarity, "CELL_SETS", size)
        assert {tuple(r) for r in similarity.near_pairs(df, "id", "t", 0.85, "s").collect()} == want
