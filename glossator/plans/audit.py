"""The audit: checks as lazy plans, each reduced to a few rows, and verdicts on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.functions import safety
from glossator.functions.text import fingerprint
from glossator.operators import contamination, phrases, probe, similarity, spans, validation, values
from glossator.schema import SPLITS

from .config import Config
from .profiles import thresholds, weaker

REPORTED = 20


@dataclass
class Finding:
    """A named verdict: PASS, WARN, FAIL or UNMEASURED, the measured value and its threshold."""

    risk: str
    status: str
    count: int | None
    measured: float | None = None
    threshold: float | None = None
    details: dict = field(default_factory=dict)


@dataclass
class Context:
    records: DataFrame
    limits: dict[str, float]
    config: Config | None = None
    with_probe: bool = False


@dataclass
class Check:
    risks: tuple[str, ...]
    run: Callable[[Context], list[Finding]]
    needs_config: bool = False


CHECKS: list[Check] = []


def check(*risks: str, needs_config: bool = False):
    def add(f):
        CHECKS.append(Check(risks, f, needs_config))
        return f

    return add


def _verdict(risk: str, failed: bool, count: int, measured=None, threshold=None, **details) -> Finding:
    return Finding(risk, "FAIL" if failed else "PASS", count, None if measured is None else round(measured, 4), threshold, details)


def _unmeasured(risk: str, why: str) -> Finding:
    return Finding(risk, "UNMEASURED", None, details={"reason": why})


@check("cross_split_value_contamination", "persona_contamination", "template_contamination", "skeleton_contamination")
def _contamination(ctx):
    rows = contamination.cross_split(ctx.records).collect()
    out = []
    for risk, dimension in zip(CHECKS[0].risks, ("value", "persona", "template", "skeleton")):
        if dimension == "template" and ctx.config is None:
            out.append(_unmeasured(risk, "templates are not known"))
            continue
        met = {f"{r.split_a}/{r.split_b}": r.n for r in rows if r.dimension == dimension}
        out.append(_verdict(risk, bool(met), sum(met.values()), pairs=met))
    return out


@check("duplicate_or_near_duplicate_bodies")
def _duplicates(ctx):
    exact = contamination.body_copies(ctx.records).agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    limit = ctx.limits["near_duplicate_jaccard"]
    pairs = similarity.near_pairs(ctx.records, "case_id", "text", limit)
    bodies = ctx.records.select(F.col("case_id"), F.md5(fingerprint("text").cast("binary")).alias("f"))
    near = pairs.join(bodies.select(F.col("case_id").alias("l"), F.col("f").alias("fl")), "l").join(bodies.select(F.col("case_id").alias("r"), F.col("f").alias("fr")), "r").filter("fl <> fr").count()
    return [_verdict("duplicate_or_near_duplicate_bodies", exact + near > 0, exact + near, exact + near, 0, exact=exact, near=near, jaccard_threshold=limit)]


@check("intra_split_redundancy")
def _redundancy(ctx):
    limit = ctx.limits["intra_split_similarity_threshold"]
    rows = contamination.redundancy(ctx.records, *similarity.near_classes(ctx.records, "case_id", "text", limit, "split")).collect()
    kinds = {r.split: r.n for r in ctx.records.groupBy("split").agg(F.count_distinct(F.md5(contamination.record_skeleton(ctx.records).cast("binary"))).alias("n")).collect()}
    worst = max((r.involved / r.total for r in rows), default=0.0)
    most = ctx.limits["max_intra_split_near_dup_fraction"]
    return [_verdict("intra_split_redundancy", worst > most, sum(r.pairs for r in rows), worst, most, similarity_threshold=limit, per_split={r.split: {"pairs": r.pairs, "near_duplicate_records": r.involved, "fraction": round(r.involved / r.total, 4), "skeleton_ratio": round(kinds[r.split] / r.total, 4)} for r in rows})]


@check("label_exclusive_morphology", "morphology_label_dominance", needs_config=True)
def _morphology(ctx):
    rows = values.shape_labels(ctx.records, ctx.config.labels_table(ctx.records.sparkSession).select("name", "morphology_group")).collect()
    alone = sorted(f"{r.group}:{r.shape}" for r in rows if r.labels == 1)
    most = ctx.limits["max_morphology_label_share"]
    over = sorted((r.group, r.shape, round(r.top / r.total, 4)) for r in rows if r.top / r.total > most)
    return [_verdict("label_exclusive_morphology", bool(alone), len(alone), len(alone), 0, shapes=alone), _verdict("morphology_label_dominance", bool(over), len(over), max((r.top / r.total for r in rows), default=0.0), most, shapes=over)]


@check("shape_entity_shortcut")
def _shape_entity(ctx):
    rows = values.shape_entity(ctx.records).filter(F.col("support") >= ctx.limits["minimum_shape_support"]).collect()
    most = ctx.limits["max_shape_entity_share"]
    over = sorted((r.shape, r.annotated, r.support) for r in rows if r.annotated / r.support > most)
    return [_verdict("shape_entity_shortcut", bool(over), len(over), max((r.annotated / r.support for r in rows), default=0.0), most, shapes=over)]


@check("cue_label_shortcuts")
def _cues(ctx):
    if not ctx.records.filter(F.size("cue_links") > 0).limit(1).count():
        return [_unmeasured("cue_label_shortcuts", "no cue links")]
    rows = {r.split: r for r in values.cue_shortcuts(ctx.records).collect()}
    there = [r.split for r in ctx.records.select("split").distinct().collect()]
    # A split without cued records counts as wholly exclusive.
    part = {s: rows[s].exclusive_records / rows[s].with_cues if s in rows else 1.0 for s in there}
    most = ctx.limits["max_label_exclusive_cue_fraction"]
    return [_verdict("cue_label_shortcuts", max(part.values()) > most, sum(r.exclusive_records for r in rows.values()), max(part.values()), most, per_split={s: {"fraction": round(f, 4), "exclusive_cues": list(rows[s].exclusive_cues) if s in rows else []} for s, f in sorted(part.items())})]


def _marks(ctx, source, klass, most, skip_cues=False):
    tokens = phrases.marker_tokens(contamination.record_skeleton(source))
    found = phrases.offending(phrases.class_markers(source, tokens, klass, int(ctx.limits["minimum_marker_support"])), most, ctx.limits["minimum_marker_kind_coverage"])
    if skip_cues and ctx.config:
        cues = [c.lower() for label in ctx.config.labels for c in label.cues]
        found = found.filter(~F.exists(F.array(*map(F.lit, cues)), lambda c: c.contains(F.col("feature"))))
    rows = found.orderBy("width", F.desc("support"), "feature")
    return rows.count(), [(r.feature, r["class"], round(r.share, 4), round(r.coverage, 4), r.support) for r in rows.limit(REPORTED).collect()]


@check("label_marker_shortcuts")
def _label_markers(ctx):
    one = ctx.records.filter(F.size("annotations") == 1).withColumn("label", F.col("annotations")[0]["entity_type"])
    most = ctx.limits["max_label_marker_share"]
    n, top = _marks(ctx, one, "label", most, skip_cues=True)
    return [_verdict("label_marker_shortcuts", n > 0, n, n, most, marker_features=top)]


def _valid(ctx, plugin):
    found = validation.evidence(ctx.records, ctx.config).filter((F.col("plugin") == plugin) & (F.col("kind") == "positive") & (F.size("annotations") > 0) & (F.size("evidence_faults") == 0))
    n = {r.split: r["count"] for r in found.groupBy("split").count().collect()}
    return {s: n.get(s, 0) for s in SPLITS}


@check("cue_free_coverage", needs_config=True)
def _cue_free(ctx):
    n = _valid(ctx, "cue_free")
    return [_verdict("cue_free_coverage", not all(n.values()), sum(n.values()), per_split=n)]


@check("cue_shape_contrastive_coverage", needs_config=True)
def _contrastive(ctx):
    n = _valid(ctx, "cue_shape_conflict")
    return [_verdict("cue_shape_contrastive_coverage", not all(n.values()), sum(n.values()), per_split=n)]


@check("template_diversity", "persona_diversity", needs_config=True)
def _diversity(ctx):
    spark = ctx.records.sparkSession
    splits = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    families = ctx.config.families_table(spark)
    shown = F.when(F.lower("text").contains(F.lower("persona")), F.col("persona"))
    out = []
    for risk, fams, v, floor in (("template_diversity", families, "template_id", "minimum_templates_per_family"), ("persona_diversity", families.filter("role = 'positive'"), shown, "minimum_personas_per_family")):
        rows = values.cells(ctx.records, fams.select("family"), splits, v).collect()
        least = ctx.config.diversity[floor]
        thin = {f"{r.split}/{r.family}": r.n for r in rows if r.n < least}
        out.append(_verdict(risk, bool(thin), len(thin), min(r.n for r in rows), least, cells=dict(sorted(thin.items()))))
    return out


@check("hard_negative_coverage", needs_config=True)
def _hard_negatives(ctx):
    rows = values.split_counts(ctx.records).collect()
    kinds = sorted(r[0] for r in ctx.records.filter("kind = 'hard_negative'").select("hard_negative_kind").distinct().collect() if r[0])
    low = {r.split: round(r.negatives / r.records, 4) for r in rows if r.negatives / r.records < ctx.config.minimum_hard_negative_ratio}
    least = ctx.limits["minimum_hard_negative_kinds"]
    return [_verdict("hard_negative_coverage", len(kinds) < least or bool(low), sum(r.negatives for r in rows), len(kinds), least, kinds=kinds, ratio_failures=low)]


@check("family_imbalance", needs_config=True)
def _imbalance(ctx):
    top = values.shares(ctx.records, "family").orderBy(F.desc("n")).first()
    share = top.n / top.total if top else 1.0
    return [_verdict("family_imbalance", share > ctx.limits["max_family_share"], top.n if top else 0, share, ctx.limits["max_family_share"], share=round(share, 4))]


@check("value_diversity")
def _value_diversity(ctx):
    rows = values.distinct_values(ctx.records).collect()
    if not rows:
        return [_unmeasured("value_diversity", "no annotated values")]
    least = ctx.limits["minimum_distinct_values_per_label"]
    thin = {r.label: r.distinct_n for r in rows if r.distinct_n < least}
    return [_verdict("value_diversity", bool(thin), sum(r.distinct_n for r in rows), min(r.distinct_n for r in rows), least, thin_labels=thin, distinct_count_entropy_bits=round(values.value_entropy(ctx.records).first().bits, 4))]


@check("value_shared_affix")
def _affix(ctx):
    most = ctx.limits["max_shared_affix_chars"]
    rows = values.dominant_affixes(ctx.records).collect()
    over = {f"{r.label}/{r.side}": (r.affix, r.width, round(r.n / r.total, 4)) for r in rows if r.width > most}
    return [Finding("value_shared_affix", "WARN" if over else "PASS", len({k.split("/")[0] for k in over}), max((r.width for r in rows), default=0), most, {"labels": over})]


@check("malformed_or_unbalanced_spans")
def _spans(ctx):
    n = ctx.records.filter(F.size(spans.span_faults("text", "annotations")) > 0).count()
    return [_verdict("malformed_or_unbalanced_spans", n > 0, n, n, 0)]


@check("unsafe_generated_value_patterns", needs_config=True)
def _unsafe(ctx):
    n = ctx.records.filter(F.size(validation.unsafe(ctx.config)) > 0).count()
    return [_verdict("unsafe_generated_value_patterns", n > 0, n, n, 0)]


@check("generator_fingerprint")
def _fingerprint(ctx):
    top = values.shares(ctx.records, "template_id").orderBy(F.desc("n")).first() if ctx.config else None
    share, most = (top.n / top.total if top else 0.0), ctx.limits["max_template_share"]
    n, marks = _marks(ctx, ctx.records, "kind", ctx.limits["max_kind_marker_share"])
    return [_verdict("generator_fingerprint", share > most or n > 0, n or (top.n if top else 0), share, most, marker_features=marks)]


@check("pervasive_phrase_fingerprint")
def _pervasive(ctx):
    total = ctx.records.count()
    if total < 20:
        return [_unmeasured("pervasive_phrase_fingerprint", "fewer than 20 records")]
    most = ctx.limits["max_pervasive_ngram_coverage"]
    rows = phrases.most_pervasive(ctx.records, contamination.record_skeleton(ctx.records), REPORTED).collect()
    # At the ceiling counts as over it, unlike in the other checks.
    over = [(r.gram, round(r.df / total, 4)) for r in rows if r.df / total >= most]
    return [_verdict("pervasive_phrase_fingerprint", bool(over), len(over), rows[0].df / total if rows else 0.0, most, ngrams=over)]


@check("probe_kind_separability", "probe_value_label_shortcut", "probe_context_label_shortcut")
def _probe(ctx):
    out = []
    there = {r.split for r in ctx.records.select("split").distinct().collect()}
    train = "train" if "train" in there else min(there, default="train")
    for risk, (name, examples) in zip(("probe_kind_separability", "probe_value_label_shortcut", "probe_context_label_shortcut"), probe.tasks(ctx.records).items()):
        if not ctx.with_probe:
            out.append(_unmeasured(risk, "the probe was not asked for"))
            continue
        rows, why = probe.probe(examples, train)
        limit = ctx.limits[f"probe.max_{name}_accuracy"]
        if why:
            out.append(_unmeasured(risk, why))
            continue
        bad = sorted(r.split for r in rows if round(r.balanced_accuracy, 4) > limit and round(r.balanced_accuracy, 4) > round(r.balanced_baseline, 4) + probe.MARGIN)
        out.append(_verdict(risk, bool(bad), len(rows), max(r.balanced_accuracy for r in rows), limit, failing_splits=bad))
    return out


@check("threshold_strictness")
def _strictness(ctx):
    found = weaker(ctx.limits)
    return [Finding("threshold_strictness", "WARN" if found else "PASS", len(found), details={"weaker_than_reference": found})]


@check("same_generator_holdout_dependence")
def _holdout(ctx):
    return [_unmeasured("same_generator_holdout_dependence", "a held-out split of the same source says nothing of other sources")]


def audit(records: DataFrame, config: Config | None = None, profile: str = "config", with_probe: bool = False) -> list[Finding]:
    """All checks over a corpus; those that need a configuration are UNMEASURED without one."""
    limits = thresholds() if profile == "reference" or config is None else dict(config.audit)
    ctx = Context(records, limits, config, with_probe)
    out: list[Finding] = []
    for c in CHECKS:
        out += [_unmeasured(r, "needs a configuration") for r in c.risks] if c.needs_config and config is None else c.run(ctx)
    return out


def audit_external(records: DataFrame, with_probe: bool = True, fail_on_safety: bool = False, domains=safety.DOMAINS) -> list[Finding]:
    """The checks that need no configuration, and a scan for unsafe texts."""
    out = [_unmeasured("corpus_integrity", "foreign data have no manifest"), *audit(records, None, "reference", with_probe)]
    reasons = records.select(F.explode(safety.text_reasons("text", domains)).alias("reason")).groupBy("reason").count().collect()
    n = records.filter(F.size(safety.text_reasons("text", domains)) > 0).count()
    status = "PASS" if not n else "FAIL" if fail_on_safety else "WARN"
    return [*out, Finding("external_safety_scan", status, n, details={"reasons": {r.reason: r["count"] for r in reasons}})]


def rollup(findings: list[Finding]) -> str:
    """One status for all: FAIL before the rest, else PASS and what limits it."""
    seen = {f.status for f in findings}
    if "FAIL" in seen:
        return "FAIL"
    extra = [name for status, name in (("WARN", "WARNINGS"), ("UNMEASURED", "UNMEASURED")) if status in seen]
    return "PASS" + (f"_WITH_{'_AND_'.join(extra)}" if extra else "")


def render(findings: list[Finding], kind: str = "text") -> str:
    if kind == "json":
        return json.dumps({"status": rollup(findings), "findings": [vars(f) for f in findings]}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if kind == "markdown":
        return "\n".join(["| risk | status | count | measured | threshold |", "|-|-|-|-|-|", *(f"| {f.risk} | {f.status} | {f.count} | {f.measured} | {f.threshold} |" for f in findings)]) + "\n"
    return "\n".join([f"{f.status:10} {f.risk} count={f.count} measured={f.measured} threshold={f.threshold}" for f in findings] + [f"status {rollup(findings)}"]) + "\n"
