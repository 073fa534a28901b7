"""Rules that a corpus must meet, as rows (code, split, case_id, message)."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.functions.identity import generated_id, namespace_index
from glossator.functions.safety import record_reasons
from glossator.functions.text import casefold, contains_folded, fingerprint, shape
from glossator.schema import RECORD_VERSION, SPLITS

from glossator.sources.intermediate import stored

from .contamination import record_skeleton, shared_dimensions
from .spans import span_faults
from .values import cells, split_counts

if TYPE_CHECKING:
    from glossator.plans.config import Config

GENERATOR_VERSION = "2"


def unsafe(config: Config) -> Column:
    s = config.safety
    return record_reasons("text", "annotations", {x.name: x.plugin for x in config.labels}, s["allowed_value_prefixes"], s["reserved_email_domains"], s["forbidden_terms"], s["mode"])


def cue_faults(config: Config) -> Column:
    """Faults of a record's cue links, in the order of the rules; needs the column plugin."""
    links, spans = F.coalesce("cue_links", F.array().cast("array<struct<cue: string, entity_type: string>>")), F.col("annotations")
    labels = F.transform(spans, lambda a: a["entity_type"])
    names = [x.name for x in config.labels]
    cue = lambda c: contains_folded("text", c)
    linked = F.transform(links, lambda c: F.struct(casefold(c["cue"]).alias("cue"), c["entity_type"].alias("label")))
    known = [(c.lower(), x.name) for x in config.labels for c in x.cues]
    shown = F.array(*(F.when(casefold("text").contains(c), F.lit(c)) for c, _ in known))
    unlinked = F.lit(False)
    for c, name in known:
        unlinked = unlinked | (casefold("text").contains(c) & F.array_contains(labels, name) & ~F.exists(linked, lambda x: x["cue"] == c))
    free, positive = F.coalesce(F.col("plugin") == "cue_free", F.lit(False)), F.col("kind") == "positive"
    general = [
        (F.exists(links, lambda c: F.trim(F.coalesce(c["cue"], F.lit(""))) == ""), "empty cue"),
        (F.size(F.array_distinct(linked)) < F.size(linked), "repeated cue link"),
        (F.exists(links, lambda c: ~cue(c["cue"])), "cue is not in the text"),
        (F.exists(links, lambda c: ~c["entity_type"].isin(names)), "link to an unknown label"),
        (F.exists(links, lambda c: ~F.array_contains(labels, c["entity_type"])), "link to a label without annotation"),
        (positive & free & (F.size(links) > 0), "cue-free record has links"),
        (positive & free & F.exists(shown, lambda c: c.isNotNull()), "cue-free record shows a cue"),
        (positive & ~free & (F.size(links) == 0), "no cue links"),
        (positive & ~free & F.exists(labels, lambda x: ~F.exists(linked, lambda c: c["label"] == x)), "annotation without a cue"),
        (positive & ~free & unlinked, "cue in the text is not linked"),
        (positive & ~free & F.col("cue_surface").isNotNull() & ~F.exists(linked, lambda c: c["cue"] == casefold("cue_surface")), "cue surface is not linked"),
    ]
    negative = F.when(F.size(links) > 0, F.array(F.lit("negative record has cue links"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("kind") == "hard_negative", negative).otherwise(F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in general))))


def contrast_faults(config: Config) -> Column:
    """Faults of a record whose value has the shape that another label prefers."""
    hint, recorded = F.col("metadata")["shape_hint_label"], F.col("metadata")["shape_signature"]
    one = F.get("annotations", F.lit(0))
    actual = shape(one["text"])
    preferred = F.lit(None).cast("string")
    for x in config.labels:
        preferred = F.when(hint == x.name, F.lit(x.options.get("preferred_shape"))).otherwise(preferred)
    tests = [
        (F.size("annotations") != 1, "not exactly one annotation"), (~F.coalesce(F.col("metadata")["contrastive"] == "true", F.lit(False)), "not marked as contrastive"),
        (~F.coalesce(hint.isin([x.name for x in config.labels]), F.lit(False)), "unknown hint label"), (F.coalesce(hint == one["entity_type"], F.lit(False)), "the hint is the label itself"),
        (~F.coalesce(preferred == actual, F.lit(False)), "the value lacks the hinted shape"), (~F.coalesce(recorded == actual, F.lit(False)), "the recorded shape is another"),
    ]
    return F.concat(cue_faults(config), F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests))))


def evidence(records: DataFrame, config: Config) -> DataFrame:
    """``records`` with plugin, role and evidence_faults; those are null for an unknown family."""
    known = records.join(F.broadcast(config.families_table(records.sparkSession)), "family", "left")
    return known.withColumn("evidence_faults", F.when(F.col("plugin") == "cue_shape_conflict", contrast_faults(config)).when(F.col("plugin").isNotNull(), cue_faults(config)))


def _named(dimension: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("v")))


def violations(records: DataFrame, config: Config) -> DataFrame:
    """(code, split, case_id, message) of all rules on records, splits and the corpus.

    A record of an unknown family breaks that rule and is left out of the
    rules after it. Rules on single records are one projection of one scan,
    which also gives what the others need, as a stored table without texts.
    """
    spark = records.sparkSession
    rows = evidence(records, config)
    known = F.col("plugin").isNotNull()
    labels = [x.name for x in config.labels]
    index = namespace_index(F.col("namespace"), F.col("split"), F.col("family"))
    own_id = generated_id(config.digest, GENERATOR_VERSION, F.col("split"), F.col("family"), index, F.col("text"))
    hidden = lambda c: (F.length(c) > 0) & ~contains_folded("text", F.col(c))
    tests = [
        (F.col("schema_version") != RECORD_VERSION, "record_schema"), (index.isNull(), "split_namespace"), (index.isNotNull() & (F.col("provenance") == "generated") & (F.col("case_id") != own_id), "case_id"), (~known, "family"),
        (known & (F.col("kind") != F.col("role")), "family_role"), (known & (F.col("kind") == "positive") & (F.size("annotations") == 0), "positive_annotations"),
        (known & (F.col("kind") == "hard_negative") & (F.size("annotations") > 0), "negative_annotations"), (known & (F.col("kind") == "hard_negative") & (F.coalesce(F.length("hard_negative_kind"), F.lit(0)) == 0), "negative_kind"),
        (known & (F.size("evidence_faults") > 0), "semantic_evidence"), (known & hidden("persona"), "persona_surface"), (known & hidden("organization"), "organization_surface"),
        (known & F.exists("annotations", lambda a: ~a["entity_type"].isin(labels)), "entity_label"), (known & (F.size(span_faults("text", "annotations")) > 0), "span"), (known & (F.size(unsafe(config)) > 0), "safety"),
    ]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for t, c in tests)))
    shown = lambda c: F.when(contains_folded("text", F.col(c)), F.col(c))
    # Texts are looked at once; all further rules read this table.
    light = stored(
        rows.select(
            "split", "case_id", "namespace", "family", "template_id", "kind", "persona", "organization", known.alias("known"), codes.alias("codes"), F.md5(fingerprint("text").cast("binary")).alias("body"),
            F.md5(record_skeleton(rows).cast("binary")).alias("skeleton"), F.col("annotations.text").alias("values"), shown("persona").alias("persona_shown"),
        ),
        "rule-facts",
    )
    found = light.select("split", "case_id", F.explode("codes").alias("code")).select("code", "split", "case_id", F.lit("").alias("message"))

    def of(df: DataFrame, code: str, split="split", case="null", message="''") -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.expr(split).cast("string").alias("split"), F.expr(case).cast("string").alias("case_id"), F.expr(message).cast("string").alias("message"))

    good = light.filter("known")
    parts = [found]
    for column, code in (("case_id", "duplicate_case_id"), ("namespace", "duplicate_namespace")):
        parts.append(of(light.groupBy(column).count().filter("count > 1"), code, "null", column if column == "case_id" else "null", column))
    bodies = good.groupBy("body").agg(F.count("*").alias("n"), F.min("case_id").alias("case_id")).filter("n > 1")
    parts.append(of(bodies, "duplicate_body", "null", "case_id", "n"))
    repeats = good.select("split", F.explode("values").alias("v")).groupBy("split", "v").count().filter("count > 1").groupBy("split").agg(F.count("*").alias("n"))
    parts.append(of(repeats, "within_split_value_uniqueness", message="n"))
    # The dimensions share one shuffle, on the dimension and the value.
    dims = {"value": F.col("values"), "persona": F.array("persona_shown"), "organization": F.array("organization"), "template": F.array("template_id"), "skeleton": F.array("skeleton"), "namespace": F.array("namespace")}
    named = [_named(k, c) for k, c in dims.items()]
    met = shared_dimensions(good.select("split", F.explode(F.flatten(F.array(*named))).alias("x")).select("split", "x.dimension", "x.v"))
    parts.append(met.select(F.concat(F.lit("cross_split_"), "dimension", F.lit("s")).alias("code"), F.concat_ws("/", "split_a", "split_b").alias("split"), F.lit(None).cast("string").alias("case_id"), F.col("n").cast("string").alias("message")))
    splits = spark.createDataFrame([(s, n, int(n * config.positive_ratio)) for s, n in config.splits.items()], "split string, size int, wanted int")
    sizes = F.broadcast(splits).join(split_counts(light), "split", "left").fillna(0)
    d = config.diversity
    parts.append(of(sizes.filter("records <> size"), "split_size", message="records"))
    parts.append(of(sizes.filter("positives <> wanted"), "positive_ratio", message="positives"))
    parts.append(of(sizes.filter(f"records > 0 and negatives / records < {config.minimum_hard_negative_ratio}"), "hard_negative_ratio", message="negatives"))
    parts.append(of(sizes.filter(f"organizations < {d['minimum_organizations_per_split']}"), "organization_diversity", message="organizations"))
    families, grid = config.families_table(spark), spark.createDataFrame([(s,) for s in SPLITS], "split string")
    parts.append(of(cells(good, families.select("family"), grid).filter(f"n < {d['minimum_templates_per_family']}"), "template_diversity", message="family"))
    parts.append(of(cells(good, families.filter("role = 'positive'").select("family"), grid, "persona").filter(f"n < {d['minimum_personas_per_family']}"), "persona_diversity", message="family"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
