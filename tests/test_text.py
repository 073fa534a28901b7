"""Text functions and set joins against plain Python."""

import sys
import zlib
from collections import Counter

from pyspark.sql import functions as F

from glossator.functions import identity, text
from glossator.operators import similarity, spans
from glossator.plans import catalogue
from glossator.schema import ANNOTATIONS


def test_case_folding_is_pythons(spark):
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c and not 0xD800 <= ord(c) < 0xE000 and c.lower() != "i̇"]
    # Some letters are newer than the Java that lower-cases them.
    rows = [c for c in odd if ord(c) < 0x1C89 or 0x1E00 <= ord(c) < 0x2C00] + ["Straße ẞ ﬁne ΑΣ ſ", "plain ASCII", "ñandú ÑANDÚ", "", None, "🙂 ß"]
    got = spark.createDataFrame([(c,) for c in rows], "t string").select("t", text.casefold("t").alias("f")).collect()
    assert [(r.t, r.f) for r in got if r.f != (None if r.t is None else r.t.casefold())] == []


def test_character_grams_of_each_document(spark):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40").collect():
        own = r.text.casefold()
        want[r.doc_id] = Counter(zlib.crc32(own[i : i + w].encode()) & 0x3FFFF for w in (3, 4, 5) for i in range(len(own) - w + 1))
    got = {}
    for r in catalogue.QUERIES["q29_char_gram_features"](spark, folder).filter("doc_id < 40").collect():
        got.setdefault(r.doc_id, Counter())[r.bucket] = r.cnt
    assert got == {k: v for k, v in want.items() if v}


def test_matches_have_code_point_offsets(spark):
    rows = ["🙂é 12-34-56 and AB1, 1.2.3", "none", "", None, "AB1AB1 AB1"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.matches("t", text.IDENTIFIER).alias("m")).collect()]
    for t, found in zip(rows, got):
        assert found is None if t is None else all(t[m.start : m.end] == m.text for m in found)
    assert [len(m) for m in got if m is not None] == [3, 0, 0, 2]


def test_copies_are_paired_and_groups_stay_apart(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(i, same if i < 4 else same + " more" if i == 4 else "other words are here now", g) for g in ("a", "b") for i in range(6)]
    rows = [(10 * (g == "b") + i, t, g) for i, t, g in rows]
    df = spark.createDataFrame(rows, "id long, t string, s string").repartition(3)
    got = {(r.g, r.l, r.r) for r in similarity.near_pairs(df, "id", "t", 0.9, "s").collect()}
    assert got == {(g, o + i, o + j) for g, o in (("a", 0), ("b", 10)) for i in range(5) for j in range(i + 1, 5)}


def test_containment_with_and_without_held_hashes(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:])), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:14])), (3, " ".join(words[:8])), (4, None), (5, "")], "doc_id long, text string")
    want = {(1, 1, 17, 17), (2, 1, 17, 17), (1, 2, 11, 17)}
    for most in (similarity.ITEM_HASHES, 0):
        monkeypatch.setattr(similarity, "ITEM_HASHES", most)
        assert {(r["item"], r.doc, r.both, r.total) for r in similarity.containment(items, "item_id", "text", docs, "doc_id", "text").collect()} == want


def test_tags_of_cut_shared_and_missing_spans(spark):
    t = "alpha beta gamma"
    rows = [("cut", t, [("P", 0, 3, 0, 3, "alp")]), ("two", t, [("P", 0, 10, 0, 10, "alpha beta"), ("Q", 6, 16, 6, 16, "beta gamma")]), ("none", t, None), ("gone", None, []), ("lead", t, [("P", 5, 10, 5, 10, " beta")])]
    rec = spark.createDataFrame([(i, "train", x, a) for i, x, a in rows], f"case_id string, split string, text string, annotations {ANNOTATIONS}")
    got = {}
    for r in spans.tagged(rec).orderBy("case_id", "pos").collect():
        got.setdefault(r.case_id, []).append(r.tag)
    assert got == {"cut": [None, "O", "O"], "two": ["B-P", None, "I-Q"], "none": ["O", "O", "O"], "lead": ["O", "B-P", "O"]}


def test_an_identity_of_a_null_text_is_null(spark):
    row = spark.createDataFrame([("a", None), ("a", "t")], "s string, t string").select(identity.external_id(F.col("s"), F.lit(1), F.col("t")).alias("i")).collect()
    assert row[0].i is None and row[1].i.startswith("ext-")


def test_shingles_differ_as_word_grams_do(spark):
    texts = ["", "  ", "a", "A ", "a b", "b a", "a b c", "a b c d", "A  b\tc D", "a b c d e", "a b c d a b c d", "a a a a a a"]

    def grams(text: str) -> set[tuple[str, ...]]:
        words = text.casefold().split()
        return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()

    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shingles("t").alias("s")).collect()}
    for a in texts:
        assert len(got[a]) == len(set(got[a])) == len(grams(a))
        for b in texts:
            assert len(set(got[a]) & set(got[b])) == len(grams(a) & grams(b)), (a, b)
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(text.shingles("t").alias("s")).first().s == []
