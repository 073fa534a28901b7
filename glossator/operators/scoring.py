"""Predicted spans against annotated ones: matches, slices and diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.functions.text import iou
from glossator.schema import SPAN

from .spans import from_bytes

SPANS = f"array<{SPAN}>"


def gold(annotations: str | Column) -> Column:
    c = F.col(annotations) if isinstance(annotations, str) else annotations
    return F.coalesce(F.transform(c, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["entity_type"].alias("entity_type"))), F.array().cast(SPANS))


def strict_matches(g: Column, p: Column) -> Column:
    """Spans that both arrays have, each as often as both have it."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    return F.aggregate(F.array_distinct(g), F.lit(0), lambda n, s: n + F.least(count(g, s), count(p, s)))


def overlap_matches(g: Column, p: Column) -> Column:
    """Pairs of one label with IoU of at least one half, taken greedily: best first, then by position in the arrays."""
    at = lambda xs: F.transform(xs, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    pairs = F.flatten(F.transform(at(g), lambda a: F.transform(at(p), lambda b: F.struct(
        (-iou(a["s"]["start"], a["s"]["end"], b["s"]["start"], b["s"]["end"])).alias("far"), a["i"].alias("gi"), b["i"].alias("pi"), (a["s"]["entity_type"] == b["s"]["entity_type"]).alias("same")))))
    good = F.array_sort(F.filter(pairs, lambda x: x["same"] & (x["far"] <= -0.5)))
    none = F.array().cast("array<int>")
    taken = F.aggregate(
        good, F.struct(none.alias("gs"), none.alias("ps")),
        lambda seen, x: F.when(F.array_contains(seen["gs"], x["gi"]) | F.array_contains(seen["ps"], x["pi"]), seen).otherwise(F.struct(F.concat(seen["gs"], F.array(x["gi"])).alias("gs"), F.concat(seen["ps"], F.array(x["pi"])).alias("ps"))),
    )
    return F.size(taken["gs"])


MATCHERS = {"strict": strict_matches, "overlap": overlap_matches}


def paired(records: DataFrame, predictions: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Records with the columns gold and spans; one without a prediction has no spans, or is left out."""
    own = predictions.select(F.col("id").alias("__id"), F.col("spans").cast(SPANS).alias("spans"))
    met = records.join(own, F.col("case_id") == F.col("__id"), "inner" if allow_partial else "left").drop("__id")
    return met.withColumns({"gold": gold("annotations"), "spans": F.coalesce("spans", F.array().cast(SPANS))})


def unknown_ids(records: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(records.select(F.col("case_id").alias("id")), "id", "left_anti").select("id")


def repeated_ids(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def prediction_faults(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(case_id, fault) of spans that a prediction may not have."""
    s, order = F.col("spans"), F.array_sort("spans")
    neighbours = F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False)))
    tests = [
        (F.exists(s, lambda x: F.coalesce(x["start"] < 0, F.lit(True))), "negative or missing start"),
        (F.exists(s, lambda x: F.coalesce(x["start"] >= x["end"], F.lit(True))), "start not before end"),
        (F.size(F.array_distinct(s)) < F.size(s), "repeated span"),
        (F.exists(neighbours, lambda x: x), "overlapping spans"),
        (F.exists(s, lambda x: F.coalesce(x["end"] > F.length("text"), F.lit(False))), "end beyond the text"),
    ]
    if labels is not None:
        tests.append((F.exists(s, lambda x: F.coalesce(~x["entity_type"].isin(labels), F.lit(True))), "unknown label"))
    return pairs.select("case_id", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests)))).alias("fault"))


def slices(pairs: DataFrame, match: str = "strict") -> DataFrame:
    """(slice, name, tp, fp, fn): overall, by label, family, kind and split; one scan, one small shuffle.

    A span can only match one of its label, so a record's matches are the sum
    of its labels'. Each record counts its labels once and sends a row for
    each slice.
    """
    matched = MATCHERS[match]
    of = lambda xs, label: F.filter(xs, lambda s: s["entity_type"] == label)
    labels = F.array_distinct(F.concat(F.transform("gold", lambda s: s["entity_type"]), F.transform("spans", lambda s: s["entity_type"])))
    each = F.transform(labels, lambda k: F.struct(F.lit("label").alias("slice"), k.alias("name"), matched(of(F.col("gold"), k), of(F.col("spans"), k)).alias("tp"), F.size(of(F.col("spans"), k)).alias("p"), F.size(of(F.col("gold"), k)).alias("g")))
    rows = pairs.select("family", "kind", "split", "gold", "spans", each.alias("by_label"))
    tp = F.aggregate("by_label", F.lit(0), lambda n, x: n + x["tp"])
    one = lambda slice_, name: F.struct(F.lit(slice_).alias("slice"), name.cast("string").alias("name"), tp.alias("tp"), F.size("spans").alias("p"), F.size("gold").alias("g"))
    flat = rows.select(F.explode(F.concat("by_label", F.array(one("overall", F.lit("all")), one("family", F.col("family")), one("kind", F.col("kind")), one("split", F.col("split"))))).alias("x"))
    total = flat.groupBy(F.col("x.slice").alias("slice"), F.col("x.name").alias("name")).agg(F.sum("x.tp").alias("tp"), F.sum("x.p").alias("p"), F.sum("x.g").alias("g"))
    return total.select("slice", "name", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def rates(tp: int, fp: int, fn: int) -> dict[str, float | int]:
    """Precision, recall and F1, rounded; 0 where nothing is there to divide by."""
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return {"precision": round(p, 4), "recall": round(r, 4), "f1": round(2 * p * r / (p + r), 4) if p + r else 0.0, "tp": tp, "fp": fp, "fn": fn}


def triggered(pairs: DataFrame, kind: str = "hard_negative") -> DataFrame:
    """(family, triggered, scored): records of a kind for which anything was predicted."""
    return pairs.filter(F.col("kind") == kind).groupBy("family").agg(F.count_if(F.size("spans") > 0).alias("triggered"), F.count("*").alias("scored"))


def conflict_outcomes(pairs: DataFrame, conflict: Column, hint: Column, match: str = "strict") -> DataFrame:
    """(outcome, n) over conflict records with one span: gold, shape_hint, other_error or abstention, in that order."""
    g = F.element_at("gold", 1)

    def aimed(label: Column) -> Column:
        def test(s: Column) -> Column:
            place = (s["start"] == g["start"]) & (s["end"] == g["end"]) if match == "strict" else iou(g["start"], g["end"], s["start"], s["end"]) >= 0.5
            return (s["entity_type"] == label) & place

        return F.coalesce(F.exists("spans", test), F.lit(False))

    outcome = F.when(aimed(g["entity_type"]), "gold").when(aimed(hint), "shape_hint").when(F.size("spans") > 0, "other_error").otherwise("abstention")
    return pairs.filter(conflict & (F.size("gold") == 1)).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def refuse_faults(records: DataFrame, predictions: DataFrame, pairs: DataFrame, labels: list[str] | None, allow_partial: bool, allow_invalid: bool) -> None:
    """Raise where ids repeat, are not in the corpus (unless ``allow_partial``), or spans are malformed (unless ``allow_invalid``)."""
    twice = repeated_ids(predictions).orderBy("id").limit(1).collect()
    if twice:
        raise ValueError(f"prediction id {twice[0].id} occurs {twice[0].n} times")
    if not allow_partial:
        gone = unknown_ids(records, predictions).agg(F.count("*").alias("n"), F.min("id").alias("id")).first()
        if gone.n:
            raise ValueError(f"{gone.n} prediction ids are not in the corpus (first: {gone.id}); a partial score skips them")
    if not allow_invalid:
        bad = prediction_faults(pairs, labels).orderBy("case_id", "fault").limit(1).collect()
        if bad:
            raise ValueError(f"prediction {bad[0].case_id} is malformed: {bad[0].fault}")


def score(
    records: DataFrame, predictions: DataFrame, labels: list[str] | None = None, families: dict[str, tuple[str, str]] | None = None, match: str = "strict",
    byte_offsets: bool = False, allow_partial: bool = False, allow_invalid: bool = False,
) -> dict:
    """The report on predictions for records, all options applied and all faults refused.

    ``byte_offsets``: spans are in UTF-8 bytes; one that cuts a character is
    malformed. ``allow_partial``: only records with a prediction count, and
    unknown ids are skipped. ``allow_invalid``: malformed spans are scored.
    """
    if match not in MATCHERS:
        raise ValueError(f"unknown match mode {match}")
    pairs = paired(records, predictions, allow_partial)
    if byte_offsets:
        pairs = pairs.withColumn("spans", from_bytes(F.col("text"), F.col("spans")))
    refuse_faults(records, predictions, pairs, labels, allow_partial, allow_invalid)
    out = report(pairs, families, match)
    scored, told = records.count(), predictions.join(records.select(F.col("case_id").alias("id")), "id", "left_semi").count()
    return out | {"match": match, "records": told if allow_partial else scored, "predicted_records": told, "records_without_predictions": 0 if allow_partial else scored - told, "limitation": LIMITATION}


LIMITATION = "Scores on generated records say how a detector does on them, not on other data."


def render(report: dict, kind: str = "text") -> str:
    """A score report as text, json or markdown."""
    if kind == "json":
        return json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    overall = report["slices"].get("overall", {}).get("all", rates(0, 0, 0))
    keys = ("precision", "recall", "f1", "tp", "fp", "fn")
    rows = [(s, n, *(v[k] for k in keys)) for s in ("label", "family", "kind", "split") for n, v in sorted(report["slices"].get(s, {}).items())]
    if kind == "markdown":
        head = [f"# Score ({report.get('match', 'strict')})", "", f"{report.get('records', '')} records, micro F1 {overall['f1']}, macro F1 {report['macro_f1']}", "", "| slice | name | precision | recall | F1 | TP | FP | FN |", "|-|-|-|-|-|-|-|-|"]
        body = ["| " + " | ".join(map(str, r)) + " |" for r in rows]
        return "\n".join([*head, *body, "", "## Diagnostics", "", *(f"- {k}: {v}" for k, v in report["diagnostics"].items()), "", f"> {report.get('limitation', LIMITATION)}"]) + "\n"
    if kind != "text":
        raise ValueError(f"unknown report format {kind}")
    body = [f"{s:8} {n:32} " + " ".join(f"{k}={v}" for k, v in zip(keys, r)) for s, n, *r in rows]
    first = "overall  " + " ".join(f"{k}={overall[k]}" for k in keys) + f" macro_f1={report['macro_f1']}"
    return "\n".join([first, *body, *(f"{k} {v}" for k, v in report["diagnostics"].items()), report.get("limitation", LIMITATION)]) + "\n"


def report(pairs: DataFrame, families: dict[str, tuple[str, str]] | None = None, match: str = "strict") -> dict:
    """All slices and diagnostics as plain values. ``families``: name -> (plugin, role)."""
    out: dict = {"slices": {}, "diagnostics": {}}
    for r in slices(pairs, match).collect():
        out["slices"].setdefault(r.slice, {})[r.name] = rates(r.tp, r.fp, r.fn)
    by_label = out["slices"].get("label", {})
    out["macro_f1"] = round(sum(v["f1"] for v in by_label.values()) / len(by_label), 4) if by_label else 0.0
    families = families or {}
    by_family = out["slices"].get("family", {})

    def recall(names):
        tp, fn = (sum(by_family[n][k] for n in names if n in by_family) for k in ("tp", "fn"))
        return round(tp / (tp + fn), 4) if tp + fn else None

    of = lambda plugin: [n for n, (p, _) in families.items() if p == plugin]
    found = out["diagnostics"]
    cued, free = recall([n for n, (p, role) in families.items() if role == "positive" and p != "cue_free"]), recall(of("cue_free"))
    if cued is not None and free is not None:
        found |= {"cue_dependence": round(cued - free, 4), "cued_recall": cued, "cue_free_recall": free}
    conflicts = of("cue_shape_conflict")
    if conflicts:
        outcomes = {r.outcome: r.n for r in conflict_outcomes(pairs, F.col("family").isin(conflicts), F.col("metadata")["shape_hint_label"], match).collect()}
        total = sum(outcomes.values())
        for key, name in (("gold", "conflict_gold_recall"), ("shape_hint", "shape_hint_substitution_rate"), ("other_error", "other_error_rate"), ("abstention", "abstention_rate")):
            if total:
                found[name] = round(outcomes.get(key, 0) / total, 4)
    plain = recall(of("narrative"))
    for plugin, key in (("ocr_noise", "ocr"), ("spoken", "spoken")):
        own = recall(of(plugin))
        if own is not None:
            found[f"{key}_recall"] = own
            if plain is not None:
                found[f"{key}_robustness_gap"] = round(plain - own, 4)
    over = {r.family: round(r.triggered / r.scored, 4) for r in triggered(pairs).collect()}
    if over:
        found["over_trigger_by_family"] = dict(sorted(over.items()))
    return out
