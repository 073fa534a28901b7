import json

import pytest
from pyspark.sql import functions as F

from glossator.functions import safety, text
from glossator.operators import contamination, phrases, scoring, similarity, spans, validation, values
from glossator.plans import audit, generate, profiles
from glossator.schema import ANNOTATIONS
from glossator.sources import exports, external


@pytest.fixture(scope="module")
def config():
    floors = ("minimum_templates_per_family", "minimum_personas_per_family", "minimum_organizations_per_split")
    return generate.demo(splits={"train": 120, "eval": 90, "holdout": 75}, diversity=dict.fromkeys(floors, 1))


@pytest.fixture(scope="module")
def corpus(spark, config, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "records")
    generate.generate(spark, config).write.parquet(path)
    return spark.read.parquet(path)


def test_a_generated_corpus_meets_all_rules(corpus, config):
    assert validation.violations(corpus, config).collect() == []
    assert corpus.count() == 285 and corpus.select("text").distinct().count() == 285


@pytest.mark.parametrize(
    "column,change,code",
    [
        ("case_id", lambda: F.lit("same"), "duplicate_case_id"),
        ("family", lambda: F.lit("nobody"), "family"),
        ("text", lambda: F.lit("same text"), "duplicate_body"),
        ("annotations", lambda: F.transform("annotations", lambda a: a.withField("start", a["start"] + 1)), "span"),
        ("annotations", lambda: F.transform("annotations", lambda a: a.withField("text", F.lit("123-45-6789"))), "safety"),
        ("annotations", lambda: F.transform("annotations", lambda a: a.withField("text", F.lit("SYN-ID-A00000"))), "within_split_value_uniqueness"),
        ("persona", lambda: F.lit("Nobody Here"), "persona_surface"),
        ("cue_links", lambda: F.array().cast("array<struct<cue: string, entity_type: string>>"), "semantic_evidence"),
        ("template_id", lambda: F.lit("one"), "cross_split_templates"),
        ("kind", lambda: F.lit("positive"), "positive_ratio"),
    ],
)
def test_each_damage_breaks_its_rule(corpus, config, column, change, code):
    assert validation.violations(corpus.withColumn(column, change()), config).filter(F.col("code") == code).limit(1).count() == 1


def test_audit_of_a_clean_and_of_a_damaged_corpus(corpus, config):
    found = {f.risk: f for f in audit.audit(corpus, config)}
    clean = ("cross_split_value_contamination", "persona_contamination", "template_contamination", "malformed_or_unbalanced_spans", "cue_free_coverage", "cue_shape_contrastive_coverage", "hard_negative_coverage", "family_imbalance", "unsafe_generated_value_patterns", "value_diversity")
    assert {r: found[r].status for r in clean} == dict.fromkeys(clean, "PASS")
    assert found["same_generator_holdout_dependence"].status == "UNMEASURED" and found["threshold_strictness"].status == "PASS"
    assert set(found) == {r for c in audit.CHECKS for r in c.risks}
    report = json.loads(audit.render(list(found.values()), "json"))
    assert report["status"] == audit.rollup(list(found.values()))
    bad = corpus.withColumn("text", F.concat("text", F.lit(" Always the very same closing words here."))).withColumn("annotations", F.transform("annotations", lambda a: a.withField("text", F.lit("one"))))
    ctx = audit.Context(bad, profiles.thresholds(), config)
    for check in audit.CHECKS:
        if set(check.risks) & {"cross_split_value_contamination", "value_diversity", "pervasive_phrase_fingerprint", "malformed_or_unbalanced_spans"}:
            assert "FAIL" in {f.status for f in check.run(ctx)}


def _brute_pairs(rows, threshold):
    def cut(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} or ({" ".join(w)} if w else set())

    sets = {i: cut(t) for i, t in rows if t}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_near_pairs_against_brute_force(spark, threshold, monkeypatch):
    import random

    draw = random.Random(2)
    rows = []
    for k in range(60):
        own = [f"w{draw.randint(0, 60)}" for _ in range(draw.randint(1, 40))]
        rows.append((2 * k, " ".join(own)))
        own = own[: draw.randint(1, len(own))] + [f"w{draw.randint(0, 60)}" for _ in range(draw.randint(0, 3))]
        rows.append((2 * k + 1, "  ".join(own).upper()))
    rows += [(998, None), (999, ""), (1000, "  ")]
    df = spark.createDataFrame([(*r, "g") for r in rows], "id long, text string, s string").repartition(3)
    got = {(r.l, r.r) for r in similarity.near_pairs(df, "id", "text", threshold).collect()}
    assert got == _brute_pairs(rows, threshold)
    if threshold >= 0.85:
        assert {(r.l, r.r) for r in similarity.near_pairs(df, "id", "text", threshold, method="lsh").collect()} <= got


def test_thirty_variants_are_all_paired(spark):
    rows = [(i, " ".join(f"word{k}" for k in range(200)) + f" tail{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    for method in ("exact", "lsh"):
        assert similarity.near_pairs(df, "id", "text", 0.9, method=method).count() == 435


@pytest.mark.parametrize(
    "marked,fault",
    [("a [[NAME:Bo]] c", None), ("é🙂 [[NAME: Bo ]][[ID_2:x:y]] end", None), ("none", None), ("", None), ("a [[NAME:Bo", "unclosed mark"), ("a ]] b", "stray or nested mark"), ("[[name:x]]", "malformed label"), ("[[NAME: ]]", "empty value"), ("[[NAME:a[[X:b]]]]", "stray or nested mark"), ("[[NAME]]", "mark without label")],
)
def test_markup(spark, marked, fault):
    row = spark.createDataFrame([(marked,)], "t string").select(spans.parsed(F.col("t")).alias("m")).select("m.*", spans.rendered(F.col("m.text"), F.col("m.annotations")).alias("again")).first()
    if fault:
        assert row.fault is not None and row.text is None
        return
    assert row.fault is None
    assert row.again == marked.replace(": ", ":").replace(" ]]", "]]")
    for a in row.annotations:
        assert row.text[a.start : a.end] == a.text and row.text.encode()[a.byte_start : a.byte_end].decode() == a.text


def test_tags_there_and_back(spark):
    t = "Ann  Lee met ab-12 and Bo,Cy."
    ann = [("P", 0, 8), ("ID", 13, 18), ("P", 23, 25), ("P", 26, 28)]
    row = (t, [(k, s, e, s, e, t[s:e]) for k, s, e in ann])
    rec = spark.createDataFrame([("c1", "train", *row), ("c2", "train", "é plain", [])], f"case_id string, split string, text string, annotations {ANNOTATIONS}")
    tags = spans.tagged(rec)
    got = [r.tag for r in tags.filter("case_id = 'c1'").orderBy("pos").collect()]
    assert got == ["B-P", "I-P", "O", "B-ID", "I-ID", "I-ID", "O", "B-P", "O", "B-P", "O"]
    found = spans.decoded(tags, ["case_id"]).orderBy("span_no").collect()
    assert [(r.label, r.first_pos, r.last_pos) for r in found] == [("P", 0, 1), ("ID", 3, 5), ("P", 7, 7), ("P", 9, 9)]
    odd = spark.createDataFrame([("x", i, g) for i, g in enumerate(["I-A", "I-A", "I-B", "U-B", "B-A", "L-A", "O", "L-A"])], "k string, pos int, tag string")
    assert [(r.label, r.first_pos, r.last_pos) for r in spans.decoded(odd, ["k"]).orderBy("span_no").collect()] == [("A", 0, 1), ("B", 2, 2), ("B", 3, 3), ("A", 4, 5), ("A", 7, 7)]


def test_foreign_formats(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in [{"text": "é Ann here", "spans": [{"start": 2, "end": 5, "label": "P"}]}, {"text": "none", "annotations": [], "split": "other"}]))
    rows = external.read_external(spark, {"train": str(p)}).collect()
    assert {(r.split, r.kind, len(r.annotations)) for r in rows} == {("train", "positive", 1), ("other", "unannotated", 0)}
    (a,) = next(r.annotations for r in rows if r.annotations)
    assert (a.text, a.start, a.byte_start) == ("Ann", 2, 3)
    p.write_text(json.dumps({"text": "é Ann here", "spans": [{"start": 3, "end": 6, "entity_type": "P"}]}, ensure_ascii=False))
    assert external.read_external(spark, {"x": str(p)}, byte_offsets=True).first().annotations[0].text == "Ann"
    p.write_text(json.dumps({"text": "short", "spans": [{"start": 2, "end": 99, "entity_type": "P"}]}))
    with pytest.raises(Exception, match="out of bounds"):
        external.read_external(spark, {"x": str(p)}).collect()
    c = tmp_path / "b.conll"
    c.write_text("-DOCSTART- O\n\nAnn NNP B-P\nLee NNP I-P\nran VB O\n\nBo X B-P\n")
    got = external.read_external(spark, {"eval": str(c)}, "conll").collect()
    assert sorted((r.text, [x.text for x in r.annotations]) for r in got) == [("Ann Lee ran", ["Ann Lee"]), ("Bo", ["Bo"])]
    out = str(tmp_path / "hf")
    rec = external.read_external(spark, {"eval": str(c)}, "conll")
    exports.export(rec, out, "huggingface")
    back = external.read_external(spark, {"eval": out}, "hf").collect()
    assert sorted((r.text, [x.text for x in r.annotations]) for r in back) == sorted((r.text, [x.text for x in r.annotations]) for r in got)
    for kind in exports.FORMATS:
        assert exports.lines(rec, kind).count() == 2
    with pytest.raises(ValueError):
        external.read_external(spark, {})


def test_scores(spark):
    label = "struct<entity_type: string, start: int, end: int, byte_start: int, byte_end: int, text: string>"
    rec = spark.createDataFrame([("a", "f", "positive", "train", "x" * 50, [("P", 0, 10, 0, 10, "x"), ("Q", 20, 24, 20, 24, "x")]), ("b", "n", "hard_negative", "train", "y" * 9, [])], f"case_id string, family string, kind string, split string, text string, annotations array<{label}>")
    pred = spark.createDataFrame([("a", [(1, 10, "P"), (20, 24, "P")]), ("zz", [])], "id string, spans array<struct<start: int, end: int, entity_type: string>>")
    pairs = scoring.paired(rec, pred)
    strict = {(r.slice, r.name): (r.tp, r.fp, r.fn) for r in scoring.slices(pairs).collect()}
    loose = {(r.slice, r.name): (r.tp, r.fp, r.fn) for r in scoring.slices(pairs, "overlap").collect()}
    assert strict["overall", "all"] == (0, 2, 2) and loose["overall", "all"] == (1, 1, 1) and loose["label", "P"] == (1, 1, 0) and loose["label", "Q"] == (0, 0, 1)
    assert [r.id for r in scoring.unknown_ids(rec, pred).collect()] == ["zz"]
    assert {r.fault for r in scoring.prediction_faults(pairs, ["Q"]).collect()} == {"unknown label"}
    assert scoring.report(pairs, {"f": ("narrative", "positive"), "n": ("near_miss", "hard_negative")}, "overlap")["diagnostics"]["over_trigger_by_family"] == {"n": 0.0}


def test_verifiers_and_text_reasons(spark):
    good = {"reserved_email": "a.b@mail.example.com", "reserved_phone_nanp": "(212) 555-0142", "card_shaped_invalid": "4111-1111-1111-1112", "documentation_ip": "192.0.2.7", "never_issued_ssn_shape": "912-34-5678"}
    bad = {"reserved_email": "a@real.com", "reserved_phone_nanp": "212-555-0242", "card_shaped_invalid": "4111-1111-1111-1111", "documentation_ip": "8.8.8.8", "never_issued_ssn_shape": "123-45-6789"}
    one = spark.range(1)
    for k in good:
        assert one.select(safety.verified(F.lit(good[k]), k), safety.verified(F.lit(bad[k]), k)).first()[:] == (True, False)
    texts = ["mail x@real.com", "see http://example.org/a and x@a.example.net", "-----BEGIN PRIVATE KEY-----", "http://real.io", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(safety.text_reasons("t").alias("r"))
    assert [r.r for r in df.collect()] == [["unreserved e-mail domain"], [], ["private key"], ["unreserved URL host"], [], []]


def test_values_and_phrases(spark):
    rows = [("train", "f", f"the value [[ID:AB{i:03d}]] is here") for i in range(30)] + [("eval", "f", "the value [[ID:AB001]] is there")]
    rec = spark.createDataFrame(rows, "split string, family string, t string").select("split", "family", F.lit("t").alias("template_id"), F.lit(None).cast("string").alias("persona"), F.lit(None).cast("string").alias("organization"), spans.parsed(F.col("t")).alias("m")).select("*", "m.text", "m.annotations")
    assert [(r.label, r.distinct_n, r.occurrences) for r in values.distinct_values(rec).collect()] == [("ID", 30, 31)]
    top = {r.side: (r.affix, r.width) for r in values.dominant_affixes(rec).collect()}
    assert top["prefix"] == ("AB0", 3)
    met = contamination.cross_split(rec).collect()
    assert {(r.dimension, r.n) for r in met} == {("value", 1), ("template", 1)}
    df = phrases.pervasive(rec, contamination.record_skeleton(rec)).collect()
    assert {r.gram: r.df for r in df}["the value <entity> is"] == 31
    shapes = spark.createDataFrame([("SYN-ID-A12345",), ("SYN-ID-AB1234",), ("SYN-ID-x",), ("ab-12 é",)], "v string").select(text.shape("v")).collect()
    assert [r[0] for r in shapes] == ["synthetic_alpha_five", "synthetic_two_alpha_four", "synthetic_noisy", "generic:A2-99 A1"]


def test_every_threshold_has_a_direction():
    assert profiles.weaker(profiles.thresholds()) == []
    assert [k for k, _, _ in profiles.weaker(profiles.thresholds(minimum_marker_support=21, minimum_hard_negative_kinds=7))] == ["minimum_marker_support"]
    with pytest.raises(ValueError):
        profiles.thresholds(unheard_of=1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_flags_what_the_table_scan_flags(spark, tmp_path):
    from glossator.streaming import scan

    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"case_id": str(i), "split": "train", "text": t, "annotations": []} for i, t in enumerate(["fine", "x@real.com", "see https://example.com", None])]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    query = scan.scan(scan.record_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert [r.case_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_probe_query_has_all_tasks(spark, monkeypatch):
    from glossator.operators import probe
    from glossator.plans import catalogue

    rec = "split string, kind string, text string, annotations array<struct<entity_type: string, start: int, end: int, text: string>>"
    rows = []
    for split in ("train", "eval"):
        for i in range(24):
            label, value = (("EMAIL", f"a{i}@b.example"), ("PHONE", f"555-01{i:02d}"))[i % 2]
            lead = ("mail to ", "call at ")[i % 2]
            noted = [(label, len(lead), len(lead) + len(value), value)] if i % 3 else []
            rows.append((split, "positive" if noted else "negative", lead + value if noted else f"nothing is here {i}", noted))
    table = spark.createDataFrame(rows, rec)
    monkeypatch.setattr(catalogue, "records", lambda *_: table)
    got = catalogue.QUERIES["q30_probe_metrics"](spark, "").collect()
    assert {(r.task, r.split) for r in got} == {(t, "eval") for t in ("kind", "value_label", "context_label")} and len(got) == 15
    assert probe.features(table.limit(1)).first().features.size == 1 << 18
