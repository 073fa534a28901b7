import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossator.llm import pieces

VOCABULARY = pieces.vocabulary()


def _full(text, n):
    """The n best of the whole text's lattice, by one search without cutting it into units."""
    whole = (pieces.SPACE + text.replace(pieces.SPACE, pieces._LITERAL).replace(" ", pieces.SPACE)) if text else ""
    return VOCABULARY.n_best(whole, n)


def _paths(unit):
    """Every segmentation of a short unit: (score, ids)."""
    if not unit:
        return [(0.0, [])]
    return [(score + s, ids + own) for start, s, own in VOCABULARY.arcs(unit, len(unit)) for score, ids in _paths(unit[:start])]


@pytest.mark.parametrize("unit", ["▁the", "▁▁▁a", "aaaaa", "▁hello", "éüß", "x😀y", "\n", "▁在中国"])
def test_n_best_is_the_top_of_all_segmentations(unit):
    every = sorted((-s, ids) for s, ids in _paths(unit))
    for n in (1, 2, 5, 50):
        got = VOCABULARY.n_best(unit, n)
        assert [s for s, _ in got] == [-s for s, _ in every[:n]]
        assert len({tuple(i) for _, i in got}) == len(got)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" abcdeilnorst\n\t▁éñ1.,"), st.characters(codec="utf-8")), max_size=40), st.integers(1, 7))
def test_texts_have_the_n_best_of_their_whole_lattice(text, n):
    (ids,), (best,) = pieces.Encoder(VOCABULARY, n).encode([text])
    found = pieces.segmentations(ids.tolist(), best)
    assert [s for s, _ in found] == [s for s, _ in _full(text, n)]
    assert len({tuple(i) for _, i in found}) == len(found)
    for _, own in found:
        assert VOCABULARY.decode(own) == text


def test_long_units_and_forgetting():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeé xyz\n") for _ in range(rng.randrange(0, 400))) for _ in range(60)] + ["z" * 3000, "ab" * 40, None, ""]
    one, small = pieces.Encoder(VOCABULARY, 3), pieces.Encoder(VOCABULARY, 3, remembered=5)
    whole = one.encode(texts)
    for lo in range(0, len(texts), 7):
        ids, best = small.encode(texts[lo : lo + 7])
        for a, b, c, d in zip(ids, whole[0][lo:], best, whole[1][lo:]):
            assert (a is None and b is None) or a.tolist() == b.tolist()
            assert c == d
    for text, ids in zip(texts, whole[0]):
        assert text is None or VOCABULARY.decode(ids.tolist()) == text


def test_operator_edge_cases(spark):
    rows = [(1, "one two", 1), (1, "one two", 1), (None, "x", 1), (3, None, 1), (4, "", 1), (5, "word " * 30000, 1), (6, "▁ ▁▁", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    got = pieces.encoded(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0].ids == by[1][1].ids
    assert by[3][0].ids is None and by[3][0].n_best is None and by[3][0].exact is None
    assert by[4][0].ids == [] and [b.score for b in by[4][0].n_best] == [0.0]
    assert all(r.exact for r in got.collect() if r.doc_id != 3)
    back = {r.doc_id: r.text for r in pieces.decoded(got).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert pieces.encoded(docs.limit(0)).count() == 0 and pieces.encoded(docs.limit(0)).schema == got.schema
    with pytest.raises(ValueError):
        pieces.encoded(docs, n=0)
