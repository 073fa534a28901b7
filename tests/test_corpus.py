"""Corpora on disk: bytes, rules on files, refusal, reproduction, export, import, score and the command line."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

import glossator
from glossator import cli
from glossator.operators import scoring
from glossator.plans import corpus, generate
from glossator.plans.config import config_of
from glossator.sources import external


@pytest.fixture(scope="module")
def config():
    return generate.demo(splits={"train": 60, "eval": 50, "holdout": 40}, diversity=dict.fromkeys(("minimum_templates_per_family", "minimum_personas_per_family", "minimum_organizations_per_split"), 1))


@pytest.fixture(scope="module")
def folder(spark, config, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("disk") / "corpus")
    corpus.generated(spark, config, path)
    return path


@pytest.fixture
def copy(folder, tmp_path):
    return shutil.copytree(folder, str(tmp_path / "copy"))


def _codes(spark, path):
    config, records, manifest = corpus.load(spark, path)
    return {r.code for r in corpus.file_violations(spark, path, config, manifest, records).select("code").distinct().collect()}


def test_written_and_read_back(spark, folder, config):
    own, records, manifest = corpus.load(spark, folder)
    assert own == config and own.digest == config.digest and config_of(config.snapshot()) == config
    assert records.count() == 150 and set(manifest["files"]) == {"corpus-config.json", *(f"splits/{s}/part-00000.jsonl" for s in ("train", "eval", "holdout"))}
    assert manifest["counts"]["train"]["records"] == 60 and sum(manifest["counts"]["train"]["families"].values()) == 60
    lines = open(f"{folder}/splits/eval/part-00000.jsonl").read().splitlines()
    assert len(lines) == 50 and all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
    assert [json.loads(x)["namespace"] for x in lines] == sorted(json.loads(x)["namespace"] for x in lines)
    assert corpus.validate(spark, folder).valid
    with pytest.raises(ValueError, match="not empty"):
        corpus.generated(spark, config, folder)


def test_bytes_do_not_depend_on_partitions_and_files_have_a_size(spark, folder, config, tmp_path):
    _, records, manifest = corpus.load(spark, folder)
    again = corpus.write(records.repartition(7), str(tmp_path / "again"), config)
    assert again["files"] == manifest["files"]
    small = corpus.write(records, str(tmp_path / "small"), config, rows_per_file=20)
    assert len([f for f in small["files"] if "train" in f]) == 3
    _, back, _ = corpus.load(spark, str(tmp_path / "small"))
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
    with pytest.raises(ValueError, match="occurs 2 times"):
        corpus.write(records.unionByName(records.limit(1).withColumn("case_id", F.lit("other"))), str(tmp_path / "twice"), config)


def test_reproduced_byte_for_byte_but_for_a_damaged_file(spark, copy, capsys):
    path = f"{copy}/splits/train/part-00000.jsonl"
    text = open(path).read()
    open(path, "w").write(text.replace("train", "trail", 1))
    assert cli.main(["reproduce", copy], spark) == 1
    told = dict(reversed(x.split(maxsplit=1)) for x in capsys.readouterr().out.splitlines()[:-1])
    assert {p for p, s in told.items() if s == "FAIL"} == {"splits/train/part-00000.jsonl"}
    assert {p for p, s in told.items() if s == "PASS"} == {"corpus-config.json", "manifest.json", "splits/eval/part-00000.jsonl", "splits/holdout/part-00000.jsonl"}


def _manifest(copy, **changed):
    path = f"{copy}/manifest.json"
    held = json.loads(open(path).read())
    for k, v in changed.items():
        held.pop(k) if v is None else held.update({k: v})
    open(path, "w").write(json.dumps(held))


@pytest.mark.parametrize(
    "code,damage",
    [
        ("manifest_schema", lambda c: _manifest(c, schema_version="x")), ("config_digest", lambda c: _manifest(c, configuration_digest="x")), ("data_license", lambda c: _manifest(c, generated_data_license="x")),
        ("generator_version", lambda c: _manifest(c, generator_version="")), ("claim_boundary", lambda c: _manifest(c, synthetic_holdout_limitation=None)), ("manifest_counts", lambda c: _manifest(c, counts={})),
        ("missing_file", lambda c: shutil.rmtree(f"{c}/splits/eval")), ("file_hash", lambda c: open(f"{c}/splits/eval/part-00000.jsonl", "a").write("\n")), ("file_size", lambda c: open(f"{c}/splits/eval/part-00000.jsonl", "a").write("\n")),
        ("stable_encoding", lambda c: open(f"{c}/splits/eval/part-00000.jsonl", "ab").write(b"\r\n")),
    ],
)
def test_each_damage_to_files_breaks_its_rule(spark, copy, code, damage):
    damage(copy)
    assert code in _codes(spark, copy)


def test_invalid_corpora_are_refused_or_cannot_pass(spark, copy, tmp_path):
    _manifest(copy, counts={})
    for use in (lambda: corpus.audit_corpus(spark, copy), lambda: corpus.export_corpus(spark, copy, "jsonl", str(tmp_path / "x"))):
        with pytest.raises(corpus.InvalidCorpus) as found:
            use()
        assert "manifest_counts" in found.value.report.errors[0]
    made = corpus.export_corpus(spark, copy, "spacy", str(tmp_path / "y"), forensic=True)
    assert not made["integrity_valid"] and made["records"] == 150
    assert corpus.audit_corpus(spark, copy, forensic=True)[0].status == "FAIL"


def test_a_malformed_line_is_named(spark, copy):
    path = f"{copy}/splits/train/part-00000.jsonl"
    lines = open(path).read().splitlines()
    open(path, "w").write("\n".join([*lines[:4], "", "{not json", *lines[4:]]) + "\n")
    with pytest.raises(ValueError, match=r"part-00000.jsonl:6"):
        corpus.load(spark, copy)


@pytest.mark.parametrize("kind", ["jsonl", "bio", "huggingface", "spacy", "presidio"])
def test_exports_hold_the_records(spark, folder, tmp_path, kind):
    made = corpus.export_corpus(spark, folder, kind, str(tmp_path / kind))
    assert made["records"] == 150 and made["integrity_valid"] and "labels.json" in made["files"] and len(made["files"]) > 1
    _, records, _ = corpus.load(spark, folder)
    rows = {r.case_id: r for r in records.collect()}
    text = "\n".join(open(f"{tmp_path / kind}/{p}").read() for p in made["files"] if p != "labels.json")
    if kind == "bio":
        blocks = [b.strip().splitlines() for b in text.split("# id=")[1:]]
        for head, *tokens in blocks:
            own = rows[head.split()[0]]
            assert sum(t.split("\t")[1].startswith("B-") for t in tokens) == len(own.annotations)
        assert len(blocks) == 150
        return
    held = [json.loads(x) for x in text.splitlines() if x]
    assert len(held) == 150
    for x in held:
        own = rows[x.get("case_id") or x.get("id") or x["name"]]
        want = sorted((a.start, a.end, a.entity_type) for a in own.annotations)
        spans = x["entities"] if kind == "spacy" else x["expected"] if kind == "presidio" else x["spans"] if kind == "huggingface" else x["annotations"]
        assert sorted((s[0], s[1], s[2]) if kind == "spacy" else (s["start"], s["end"], s["entity_type"]) for s in spans) == want and x["text"] == own.text


def test_import(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text('{"text": "mail [[EMAIL:a@real.com]] now", "family": "notes"}\n\nplain\n[[NAME:Bo]] é [[NAME:Cy]]\n')
    made = corpus.import_marked(spark, str(p), str(tmp_path / "out"))
    assert made["records"] == 3 and made["labels"] == {"EMAIL": 1, "NAME": 2} and made["safety_findings"] == {"flagged_record_numbers": [1], "reasons": {"unreserved e-mail domain": 1}}
    rows = external.read_records(spark, str(tmp_path / "out" / "records")).collect()
    assert {(r.family, r.split, r.kind, r.provenance) for r in rows} == {("notes", "unassigned", "positive", "human_supplied"), ("human_supplied", "unassigned", "unannotated", "human_supplied"), ("human_supplied", "unassigned", "positive", "human_supplied")}
    assert all(r.case_id.startswith("human-") and len(r.case_id) == 26 and r.metadata == {"release_status": "unreviewed"} for r in rows)
    assert sorted(map(str, external.read_marked(spark, str(p)).collect())) == sorted(map(str, rows))
    p.write_text("fine\nbad [[NAME:x\n")
    with pytest.raises(ValueError, match="record 2 has invalid annotations: unclosed mark$"):
        corpus.import_marked(spark, str(p), str(tmp_path / "o2"))
    with pytest.raises(ValueError, match="bad "):
        corpus.import_marked(spark, str(p), str(tmp_path / "o2"), debug_local=True)
    p.write_text("same\nsame\n")
    with pytest.raises(ValueError, match="repeated"):
        corpus.import_marked(spark, str(p), str(tmp_path / "o3"))
    p.write_text("\n \n")
    with pytest.raises(ValueError, match="no records"):
        corpus.import_marked(spark, str(p), str(tmp_path / "o4"))


def _gold(spark, folder, path, shift=0, as_bytes=False):
    _, records, _ = corpus.load(spark, folder)
    with open(path, "w") as f:
        for r in records.collect():
            a, b = ("byte_start", "byte_end") if as_bytes else ("start", "end")
            f.write(json.dumps({"id": r.case_id, "spans": [{"start": x[a] + shift, "end": x[b], "label": x.entity_type} for x in r.annotations]}) + "\n")
    return str(path)


def test_score_options(spark, folder, config, tmp_path):
    _, records, _ = corpus.load(spark, folder)
    labels, families = [x.name for x in config.labels], {f.name: (f.plugin, f.role) for f in config.families}
    told = lambda path, **o: scoring.score(records, external.read_predictions(spark, path), labels, families, **o)
    gold = _gold(spark, folder, tmp_path / "gold.jsonl")
    full = told(gold)
    assert full["macro_f1"] == 1.0 and full["slices"]["overall"]["all"]["f1"] == 1.0 and full["records"] == 150 and full["records_without_predictions"] == 0
    assert full["diagnostics"]["cue_dependence"] == 0.0 and full["diagnostics"]["conflict_gold_recall"] == 1.0 and full["diagnostics"]["ocr_robustness_gap"] == 0.0
    assert told(_gold(spark, folder, tmp_path / "bytes.jsonl", as_bytes=True), byte_offsets=True)["macro_f1"] == 1.0
    moved = _gold(spark, folder, tmp_path / "moved.jsonl", shift=1)
    assert told(moved)["macro_f1"] == 0.0 and told(moved, match="overlap")["macro_f1"] == 1.0
    some = tmp_path / "some.jsonl"
    some.write_text("".join(open(gold).readlines()[:10]) + json.dumps({"id": "nobody", "spans": []}) + "\n")
    with pytest.raises(ValueError, match="1 prediction ids are not in the corpus"):
        told(str(some))
    part = told(str(some), allow_partial=True)
    assert part["records"] == 10 and part["slices"]["overall"]["all"]["fn"] == 0
    first = json.loads(open(gold).readline())["id"]
    for spans, fault in (
        ([{"start": -1, "end": 2, "label": labels[0]}], "start"), ([{"start": 3, "end": 3, "label": labels[0]}], "start not before end"), ([{"start": 1, "end": 2, "label": labels[0]}] * 2, "repeated|overlapping"),
        ([{"start": 1, "end": 5, "label": labels[0]}, {"start": 3, "end": 6, "label": labels[0]}], "overlapping"), ([{"start": 1, "end": 10**6, "label": labels[0]}], "end beyond"), ([{"start": 1, "end": 2, "label": "NOPE"}], "unknown label"),
    ):
        some.write_text(json.dumps({"id": first, "spans": spans}) + "\n")
        with pytest.raises(ValueError, match=fault):
            told(str(some))
        assert told(str(some), allow_invalid=True)["records"] == 150
    some.write_text((json.dumps({"id": first, "spans": []}) + "\n") * 2)
    with pytest.raises(ValueError, match="occurs 2 times"):
        told(str(some))
    for kind in ("text", "json", "markdown"):
        assert "macro" in scoring.render(full, kind).lower() and labels[0] in scoring.render(full, kind)


def test_command_line(spark, folder, config, copy, tmp_path, capsys):
    go = lambda *a: cli.main([str(x) for x in a], spark)
    assert go("validate", folder) == 0 and "PASS" in capsys.readouterr().out
    gold = _gold(spark, folder, tmp_path / "gold.jsonl")
    assert go("score", folder, gold, "--format", "json", "--fail-under", 0.9) == 0 and json.loads(capsys.readouterr().out)["macro_f1"] == 1.0
    moved = _gold(spark, folder, tmp_path / "moved.jsonl", shift=1)
    assert go("score", folder, moved, "--fail-under", 0.9, "--out", tmp_path / "s.txt") == 1 and "f1=0.0" in (tmp_path / "s.txt").read_text()
    assert go("export", folder, "--format", "jsonl", "--out", tmp_path / "e") == 0
    _manifest(copy, counts={})
    capsys.readouterr()
    assert go("validate", copy, "--json") == 1 and json.loads(capsys.readouterr().out)["checks"]["by_code"]["manifest_counts"] == 3
    assert go("export", copy, "--format", "jsonl", "--out", tmp_path / "e2") == 1 and "manifest_counts" in capsys.readouterr().err
    assert go("score", copy, gold) == 1
    assert go("validate", tmp_path / "absent") == 2 and "operational error" in capsys.readouterr().err
    with pytest.raises(FileNotFoundError):
        go("--traceback", "validate", tmp_path / "absent")
    p = tmp_path / "in.txt"
    p.write_text("a [[NAME:Bo]]\n")
    assert go("import-annotated", p, "--out", tmp_path / "i") == 0 and go("import-annotated", p, "--out", tmp_path / "i") == 2
    with pytest.raises(SystemExit) as left:
        go("nothing")
    assert left.value.code == 2


def test_plugins_and_names(tmp_path, monkeypatch):
    (tmp_path / "own_plugin.py").write_text("import glossator\nfrom pyspark.sql import functions as F\nglossator.register_value('own_value', lambda s, g, w: F.concat(F.lit('SYN-OWN-'), g), replace=True)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    cli.load_plugins("own_plugin, ")
    assert "own_value" in generate._PLUGINS
    with pytest.raises(ValueError, match="exists"):
        glossator.register_value("own_value", None)
    assert cli.named_sources(["a/x.jsonl"], []) == {"data": "a/x.jsonl"} and cli.named_sources(["x.jsonl"], ["t=y"]) == {"t": "y", "x": "x.jsonl"}
    for bad in ((["a/x", "b/x"], []), ([], []), ([], ["t="]), ([], ["t=a", " t=b"])):
        with pytest.raises(ValueError):
            cli.named_sources(*bad)
    assert all(getattr(glossator, n) is not None for n in glossator.__all__)
    with pytest.raises(AttributeError):
        glossator.nothing  # noqa: B018


@pytest.mark.parametrize("plugin,numbers", [("fictional_identifier", 30_000), ("synthetic_date", 5376), ("reserved_phone_nanp", 26_000), ("never_issued_ssn_shape", 60_000), ("card_shaped_invalid", 30_000), ("documentation_ip", 30_000), ("reserved_email", 30_000)])
def test_values_do_not_repeat_and_are_reserved(spark, plugin, numbers):
    from glossator.functions import safety

    rows = spark.range(numbers).select(F.explode(F.array(*map(F.lit, ("train", "eval", "holdout")))).alias("split"), F.col("id").alias("g"))
    made = rows.select("split", generate._PLUGINS[plugin](F.col("split"), F.col("g"), F.lit(None).cast("string")).alias("v"))
    assert made.select("v").distinct().count() == 3 * numbers
    if plugin in safety.registered_verifiers():
        assert made.filter(~safety.verified(F.col("v"), plugin)).count() == 0
    if plugin == "fictional_identifier":
        assert made.filter(F.regexp_replace(F.regexp_replace("v", "[^0-9]", ""), "^(.)\\1*$", "") == "").count() == 0


def test_a_corpus_beyond_a_plugins_range_is_refused(spark):
    labels = [{"name": "DAY", "plugin": "synthetic_date", "cues": ["date"]}]
    with pytest.raises(ValueError, match="5376"):
        generate.generate(spark, generate.demo(labels=labels, splits={"train": 3000, "eval": 10, "holdout": 10}))
