"""Thresholds of the reference profile, and in which direction each becomes weaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (value, whether a higher one is weaker)
REFERENCE: dict[str, tuple[float, bool]] = {
    "max_morphology_label_share": (0.75, True),
    "max_label_exclusive_cue_fraction": (0.45, True),
    "max_family_share": (0.12, True),
    "minimum_hard_negative_kinds": (6, False),
    "max_template_share": (0.05, True),
    "max_kind_marker_share": (0.90, True),
    "minimum_marker_kind_coverage": (0.50, True),
    "minimum_marker_support": (20, True),
    "near_duplicate_jaccard": (0.97, True),
    "intra_split_similarity_threshold": (0.85, True),
    "max_intra_split_near_dup_fraction": (0.05, True),
    "max_shape_entity_share": (0.90, True),
    "minimum_shape_support": (20, True),
    "max_pervasive_ngram_coverage": (0.35, True),
    "max_label_marker_share": (0.90, True),
    "minimum_distinct_values_per_label": (30, False),
    "max_shared_affix_chars": (6, True),
    "probe.max_kind_accuracy": (0.90, True),
    "probe.max_value_label_accuracy": (0.90, True),
    "probe.max_context_label_accuracy": (0.90, True),
}


def thresholds(**changed: float) -> dict[str, float]:
    """The reference values, some replaced; a dot in a name is written as two underscores."""
    given = {k.replace("__", "."): v for k, v in changed.items()}
    if unknown := set(given) - set(REFERENCE):
        raise ValueError(f"unknown thresholds {sorted(unknown)}")
    return {k: given.get(k, v) for k, (v, _) in REFERENCE.items()}


def weaker(configured: dict[str, float]) -> list[tuple[str, float, float]]:
    """(key, configured, reference) of the thresholds that are weaker than the reference's."""
    return [(k, float(configured[k]), float(v)) for k, (v, high) in sorted(REFERENCE.items()) if (configured[k] > v if high else configured[k] < v)]


def strictness(spark: SparkSession, configured: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(weaker(configured), "key string, configured double, reference double")
