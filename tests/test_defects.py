"""Named defects of a generated corpus; each must fail the check that is there for it, which the clean corpus passes."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossator.operators import spans, validation
from glossator.plans import audit, generate


@pytest.fixture(scope="module")
def config():
    return generate.demo()


@pytest.fixture(scope="module")
def clean(spark, config, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clean") / "records")
    generate.generate(spark, config).write.parquet(path)
    return spark.read.parquet(path)


def _again(df, marked):
    """Records with the text and annotations of a marked text."""
    return df.withColumn("m", spans.parsed(marked)).withColumns({"text": F.col("m.text"), "annotations": F.col("m.annotations")}).drop("m")


def _values(df, new, when=None):
    """Other annotated values, by a function of the annotation; the text follows."""
    changed = F.transform("annotations", lambda a: a.withField("text", F.when(F.lit(True) if when is None else when, new(a)).otherwise(a["text"])))
    spread = spans.rendered(F.col("text"), F.col("annotations"))
    held = df.withColumns({"old": F.col("annotations"), "new": changed, "marked": spread})
    swap = F.aggregate(F.arrays_zip("old", "new"), F.col("marked"), lambda t, x: F.replace(t, F.concat(F.lit(":"), x["old"]["text"], F.lit("]]")), F.concat(F.lit(":"), x["new"]["text"], F.lit("]]"))))
    return _again(held, swap).drop("old", "new", "marked")


def _numbered(df, kind):
    return df.withColumn("n", F.when(F.col("kind") == kind, F.row_number().over(W.partitionBy("split", "kind").orderBy("namespace"))))


def _tail(df, text, kind="hard_negative"):
    return df.withColumn("text", F.when(F.col("kind") == kind, F.concat("text", F.lit(text) if isinstance(text, str) else text)).otherwise(F.col("text")))


def _first(df, column, split="train", kind="positive"):
    return df.filter((F.col("split") == split) & (F.col("kind") == kind)).orderBy("namespace").first()[column]


def _copied(df, column, follow=()):
    """The first evaluated record has the value of the first trained one."""
    source = _first(df, column)
    target = df.filter("split = 'eval' and kind = 'positive'").orderBy("namespace").first()
    hit = F.col("case_id") == target.case_id
    out = df
    for c in follow:
        out = out.withColumn(c, F.when(hit, F.replace(c, F.lit(target[column]), F.lit(source))).otherwise(F.col(c)))
    return out.withColumn(column, F.when(hit, F.lit(source)).otherwise(F.col(column)))


def _value_contamination(df, config):
    return _values(df, lambda a: F.lit("SYN-ID-A12345"), F.col("namespace").isin(f"glossator/train/narrative/{0:05d}", f"glossator/eval/narrative/{0:05d}"))


def _skeleton_contamination(df, config):
    source = df.filter("split = 'train' and kind = 'hard_negative'").orderBy("namespace").first()
    target = df.filter("split = 'eval' and kind = 'hard_negative'").orderBy("namespace").first()
    text = source.text.replace(source.persona, target.persona).replace(source.organization, target.organization)
    return df.withColumn("text", F.when(F.col("case_id") == target.case_id, F.lit(text)).otherwise(F.col("text")))


def _duplicate_body(df, config):
    two = [r.text for r in df.filter("kind = 'hard_negative'").orderBy("case_id").limit(2).collect()]
    return df.withColumn("text", F.when(F.col("text") == two[1], F.lit(two[0])).otherwise(F.col("text")))


def _labelled(df, config, new):
    return _values(df, lambda a: F.when(a["entity_type"] == config.labels[0].name, new).otherwise(a["text"]))


def _cued(df, config, only_train=False):
    """All positives cite their label's own cue."""
    own = lambda label: F.coalesce(*(F.when(label == x.name, F.lit(x.cues[-1])) for x in config.labels))
    cue = (lambda a: F.when(F.col("split") == "train", own(a["entity_type"])).otherwise(F.lit("identity value"))) if only_train else (lambda a: own(a["entity_type"]))
    hit = (F.size("annotations") > 0) & (F.col("family") != "cue_free")
    fields = F.array_join(F.transform("annotations", lambda a: F.concat(cue(a), F.lit(": [["), a["entity_type"], F.lit(":"), a["text"], F.lit("]]"))), "; ")
    links = F.transform("annotations", lambda a: F.struct(cue(a).alias("cue"), a["entity_type"].alias("entity_type")))
    marked = F.when(hit, F.concat(fields, F.lit(" for "), "persona", F.lit(" at "), "organization", F.lit(" "), "case_id")).otherwise(spans.rendered(F.col("text"), F.col("annotations")))
    held = df.withColumns({"cue_links": F.when(hit, links).otherwise(F.col("cue_links")), "marked": marked})
    return _again(held, F.col("marked")).drop("marked")


def _missing_cue_free(df, config):
    hit = (F.col("family") == "cue_free") & (F.col("split") == "train")
    return _again(df, F.concat(F.when(hit, F.lit("identity value: ")).otherwise(F.lit("")), spans.rendered(F.col("text"), F.col("annotations"))))


def _entity_shape(df, config):
    other = F.replace(F.col("text"), F.lit("SYN-ID-"), F.lit("SYN-TKT-"))
    return df.withColumn("text", F.when(F.col("kind") == "hard_negative", other).otherwise(F.col("text")))


def _near_dupes(df, config):
    held = _numbered(df, "hard_negative")
    hit = (F.col("split") == "train") & (F.col("n") <= 24)
    before = F.lag("text").over(W.partitionBy("split", "kind").orderBy("namespace"))
    return held.withColumn("text", F.when(hit & (F.col("n") % 2 == 0), F.concat(before, F.lit(" Note."))).otherwise(F.col("text"))).drop("n")


def _lexical(df, config):
    hit = (F.size("annotations") == 1) & (F.col("annotations")[0]["entity_type"] == config.labels[0].name)
    return df.withColumn("text", F.when(F.coalesce(hit, F.lit(False)), F.concat("text", F.lit(" Alpha keyword note."))).otherwise(F.col("text")))


def _one(df, column, new, kind="positive"):
    case = _first(df, "case_id", kind=kind)
    return df.withColumn(column, F.when(F.col("case_id") == case, new).otherwise(F.col(column)))


CASES = {
    "value_contamination": ("cross_split_value_contamination", _value_contamination),
    "persona_contamination": ("persona_contamination", lambda df, c: _copied(df, "persona", ("text",))),
    "template_contamination": ("template_contamination", lambda df, c: _copied(df, "template_id")),
    "skeleton_contamination": ("skeleton_contamination", _skeleton_contamination),
    "duplicate_body": ("duplicate_or_near_duplicate_bodies", _duplicate_body),
    "exclusive_morphology": ("label_exclusive_morphology", lambda df, c: _labelled(df, c, F.concat(F.lit("SYN-EXCLUSIVE-A"), F.lpad(F.pmod(F.xxhash64("case_id"), F.lit(10**7)).cast("string"), 7, "0")))),
    "morphology_dominance": ("morphology_label_dominance", lambda df, c: _labelled(df, c, F.concat(F.lit("SYN-ID-NOISY-"), F.lpad(F.pmod(F.xxhash64("case_id"), F.lit(10**7)).cast("string"), 7, "0")))),
    "cue_shortcut": ("cue_label_shortcuts", _cued),
    "train_only_cue_shortcut": ("cue_label_shortcuts", lambda df, c: _cued(df, c, True)),
    "label_marker_shortcut": ("generator_fingerprint", lambda df, c: _tail(df, F.concat(F.lit(" Synthetic sample index "), F.substring("namespace", -4, 4), F.lit(".")))),
    "unigram_label_marker": ("generator_fingerprint", lambda df, c: _tail(df, " Negmarker.")),
    "bigram_label_marker": ("generator_fingerprint", lambda df, c: _tail(df, " Subject organization.")),
    "trigram_label_marker": ("generator_fingerprint", lambda df, c: _tail(_tail(df, " Subject synthetic."), " Context subject synthetic.")),
    "missing_cue_free": ("cue_free_coverage", _missing_cue_free),
    "missing_contrastive": ("cue_shape_contrastive_coverage", lambda df, c: df.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.isin("contrastive", "shape_hint_label", "shape_signature")))),
    "thin_templates": ("template_diversity", lambda df, c: df.withColumn("template_id", F.concat_ws(":", "split", "family", F.lit("only")))),
    "thin_personas": ("persona_diversity", lambda df, c: df.withColumns({"text": F.replace("text", "persona", F.concat(F.lit("Sole "), "split")), "persona": F.concat(F.lit("Sole "), "split")})),
    "weak_hard_negatives": ("hard_negative_coverage", lambda df, c: df.withColumn("hard_negative_kind", F.when(F.col("kind") == "hard_negative", F.lit("one_kind")))),
    "family_imbalance": ("family_imbalance", lambda df, c: df.withColumn("family", F.when(F.col("kind") == "positive", F.lit("narrative")).otherwise(F.col("family")))),
    "low_value_diversity": ("value_diversity", lambda df, c: _values(df, lambda a: F.lit("SYN-ID-A00001"))),
    "entity_shape_shortcut": ("shape_entity_shortcut", _entity_shape),
    "constant_footer": ("pervasive_phrase_fingerprint", lambda df, c: df.withColumn("text", F.concat("text", F.lit(" Synthetic ledger stamp applied here.")))),
    "intra_split_near_dupes": ("intra_split_redundancy", _near_dupes),
    "label_lexical_marker": ("label_marker_shortcuts", _lexical),
    "probe_kind_giveaway": ("probe_kind_separability", lambda df, c: _tail(df, " Negmarker zeta zeta.")),
    "malformed_spans": ("malformed_or_unbalanced_spans", lambda df, c: _one(df, "annotations", F.transform("annotations", lambda a: a.withField("end", a["end"] + 1)))),
    "unsafe_value": ("unsafe_generated_value_patterns", lambda df, c: _values(df, lambda a: F.lit("UNREVIEWED-12345"), F.col("namespace") == f"glossator/train/narrative/{0:05d}")),
    "generator_fingerprint": ("generator_fingerprint", lambda df, c: df.withColumn("template_id", F.lit("one-template"))),
    "phantom_metadata": ("corpus_integrity", lambda df, c: _one(df, "organization", F.lit("Phantom House"))),
    "stale_case_id": ("corpus_integrity", lambda df, c: _one(df, "text", F.concat("text", F.lit(" Altered later.")))),
}


def _finding(df, config, risk):
    if risk == "corpus_integrity":
        n = validation.violations(df, config).count()
        return "FAIL" if n else "PASS"
    (check,) = [c for c in audit.CHECKS if risk in c.risks]
    return {f.risk: f.status for f in check.run(audit.Context(df, dict(config.audit), config, True))}[risk]


def test_the_clean_corpus_passes(clean, config):
    found = {f.risk: f.status for f in audit.audit(clean, config, with_probe=True)}
    assert {r for r, s in found.items() if s == "FAIL"} == set()
    assert {r for r, _ in CASES.values()} - {"corpus_integrity"} <= {r for r, s in found.items() if s == "PASS"}
    assert _finding(clean, config, "corpus_integrity") == "PASS"


@pytest.mark.parametrize("name", CASES)
def test_each_defect_fails_its_check(clean, config, name):
    risk, damage = CASES[name]
    assert _finding(damage(clean, config), config, risk) == "FAIL"
