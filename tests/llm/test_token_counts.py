import pytest

from glossator.llm import token_counts


@pytest.mark.parametrize("hot", [0, 3, 65_536])
def test_against_whole_encoding(spark, hot):
    texts = [
        "The cat's whiskers, 12,345 of them!", "  leading and  double   spaces\n\n\ttabs ", "naïve café 東京 Привет 🙂🙂", "", None, "a" * 30_000, "word " * 20_000,
        "don't won't I'll we've", "The cat's whiskers, 12,345 of them!", " odd spaces　here", "x\r\ny", "١٢٣ ½ ², ₃",
    ]
    rows = [(i if i != 3 else None, t, 1, "w", 2) for i, t in enumerate(texts)] + [(1, "again", 1, "w", 2), (1, "again", 1, "w", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, known int, word string, rid int").repartition(3)
    own = token_counts.encoding()
    got = sorted(((r.doc_id, r.tokens) for r in token_counts.token_counts(docs, hot=hot).collect()), key=repr)
    assert got == sorted(((r[0], len(own.encode_ordinary(r[1])) if r[1] else 0) for r in rows), key=repr)


def test_pieces_once_for_each_distinct_pretoken(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "a b"), (3, None)], "doc_id long, text string")
    got = {r.word: r.n for r in token_counts.piece_counts(docs).collect()}
    assert got == {"a": 2, " b": 3, " a": 2}
    assert token_counts.token_counts(docs.limit(0)).count() == 0
