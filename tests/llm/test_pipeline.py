import os

import pytest
from test_dedup import _brute_groups, _prints

import corpus_pipeline
from glossator.llm import common, language_id, mixing, pieces, simhash_dedup
from glossator.sources import intermediate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = common.written(docs, "test-" + name)
        found.append(docs)
    return found


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for after in stages[1:-1]:
        assert after.columns == stages[0].columns and after.count() > 0


def test_stages_against_brute_force(stages):
    docs, known, distinct, apart, mixed, last = stages
    net = language_id.fit(docs)
    good = {r.doc_id for r in language_id.identified(docs, net).filter("accepted").collect()}
    assert {r.doc_id for r in known.collect()} == good
    first = {}
    for r in sorted(known.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(first.values())
    root = {i: k for i, (k, _) in _brute_groups(_prints(distinct.filter("text rlike '[A-Za-z0-9]'")), simhash_dedup.RADIUS, simhash_dedup.SECOND_RADIUS).items()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i in first.values() if root.get(i, i) == i)
    copies = {r.doc_id: r.copies for r in mixing.rates(apart).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    rows = last.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixed.collect()) and all(r.exact for r in rows)


def _stored(spark):
    folder = intermediate.own_folder(spark).removeprefix("file://")
    return {os.path.join(folder, x) for x in os.listdir(folder)} if os.path.exists(folder) else set()


def test_run_gives_the_last_stage_and_deletes_the_others(spark, stages):
    before = _stored(spark)
    got, want = corpus_pipeline.run(spark, SF), stages[-1]
    assert got.columns == ["doc_id", *(c for c in stages[0].columns if c not in ("doc_id", "text")), "ids", "n_best", "exact"]
    assert sorted((r.doc_id, r.source, tuple(r.ids)) for r in got.collect()) == sorted((r.doc_id, r.source, tuple(r.ids)) for r in want.collect())
    (left,) = _stored(spark) - before
    assert "stage-piece_encoding" in left
    common.forget(got)
    assert _stored(spark) == before


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls in any column, empty, very long, repeated and tied rows, and columns named like inner ones."""
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 20").collect()]
    one = base[0]
    odd = [
        (None, one[1], one[2], one[3]), (None, base[1][1] + " and more of it", base[1][2], None), (9001, None, "en", "web"), (9002, "", "en", "web"), (9003, base[2][1], None, base[2][3]),
        (9004, " ".join(b[1] for b in base if b[2] == one[2])[:600_000], one[2], one[3]), (9005, "...", one[2], None), one, one, (9006, one[1], one[2], one[3]), (9007, one[1].upper(), one[2], one[3]),
    ]
    rows = [(*r, None if n % 2 else n, "x", 1.5, n) for n, r in enumerate(base + odd)]
    path = tmp_path_factory.mktemp("odd")
    shape = "doc_id long, text string, lang string, source string, rid int, node string, tokens double, ids int"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(str(path / "documents.parquet"))
    (path / "none").mkdir()
    spark.createDataFrame([], shape).write.parquet(str(path / "none" / "documents.parquet"))
    return str(path), one


def test_run_over_odd_rows(spark, odd_folder):
    folder, one = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        new = common.written(stage(spark, at, folder), name)
        texts = [r.text for r in new.collect()] if "text" in new.columns else []
        if name == "language_id":
            assert None not in texts and "" not in texts and new.columns == docs.columns
        if name == "exact_dedup":
            assert len(texts) == len(set(texts)) == at.select("text").distinct().count() and new.filter(f"doc_id = {one[0]}").count() == 1
        if name == "simhash_dedup":
            assert 9007 not in {r.doc_id for r in new.collect()}
        at = new
    assert at.columns == ["doc_id", "lang", "source", "rid", "node", "tokens", "ids_in", "ids", "n_best", "exact"]
    rows = at.collect()
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    own = pieces.vocabulary()
    assert rows and all(r.exact and (r.doc_id, own.decode(r.ids)) in whole for r in rows)
    run = corpus_pipeline.run(spark, folder)
    assert run.count() == len(rows)


def test_run_over_an_empty_table(spark, odd_folder):
    assert corpus_pipeline.run(spark, f"{odd_folder[0]}/none").count() == 0
