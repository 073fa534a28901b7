"""Corpora on disk: written with a manifest, read back, validated, reproduced, exported, imported."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.functions import safety
from glossator.functions.text import fingerprint
from glossator.operators import spans, validation, values
from glossator.schema import IMPORT_VERSION, MANIFEST_VERSION, RECORD, SPLITS
from glossator.sources import exports, external, files
from glossator.sources.intermediate import own_folder, scope

from . import audit, generate
from .config import Config, config_of

HOLDOUT_LIMITATION = "The held-out split comes from the same generator; results on it say nothing of other sources."
RESPONSIBILITY = "Imported texts are the user's own. Consent, privacy, provenance, licence and release are for the user to decide; an import shows none of them to be in order."
MIXING_POLICY = "not assigned to a generated train, eval or holdout split"
FLAGGED, LISTED = 50, 1000
_CONFIG, _MANIFEST = "corpus-config.json", "manifest.json"


@dataclass
class Report:
    """The outcome of a validation; ``errors`` has at most ``LISTED`` lines ``code: message``, ``count`` all of them."""

    count: int
    errors: list[str] = field(default_factory=list)
    checks: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.count

    def to_dict(self) -> dict:
        return {"valid": self.valid, "count": self.count, "errors": self.errors, "checks": self.checks}


class InvalidCorpus(ValueError):
    """A corpus that breaks its rules, where only a valid one may be used."""

    def __init__(self, report: Report):
        super().__init__(f"the corpus breaks {report.count} rules")
        self.report = report


def counts(records: DataFrame) -> dict[str, dict]:
    """What a manifest counts, by split."""
    out = {r.split: {k: r[k] for k in r.asDict() if k not in ("split", "families")} | {"families": {}, "hard_negative_kinds": {}, "labels": {}} for r in values.split_counts(records).collect()}
    named = records.select("split", F.explode(F.array_compact(F.concat(
        F.array(F.struct(F.lit("families").alias("what"), F.col("family").alias("name")), F.when(F.length("hard_negative_kind") > 0, F.struct(F.lit("hard_negative_kinds").alias("what"), F.col("hard_negative_kind").alias("name")))),
        F.transform("annotations", lambda a: F.struct(F.lit("labels").alias("what"), a["entity_type"].alias("name"))),
    ))).alias("x"))
    for r in named.groupBy("split", "x.what", "x.name").agg(F.count("*").alias("n")).orderBy("what", "name").collect():
        out[r.split][r.what][r.name] = r.n
    return out


def write(records: DataFrame, directory: str, config: Config, rows_per_file: int = 100_000) -> dict:
    """Write a corpus, the same bytes for the same records whatever the cluster; the manifest is returned.

    Beside the manifest there are the configuration and, for each split, a
    folder of record files of about ``rows_per_file`` lines in a fixed order.
    A folder that has something in it is refused, and so are repeated bodies.
    """
    spark = records.sparkSession
    if not files.is_empty(spark, directory):
        raise ValueError("the output folder is not empty")
    repeated = records.groupBy(F.md5(fingerprint("text").cast("binary")).alias("f")).agg(F.count("*").alias("n"), F.min("case_id").alias("case_id")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"the body of {repeated[0].case_id} occurs {repeated[0].n} times")
    return _write(records, directory, config, rows_per_file)


def _write(records: DataFrame, directory: str, config: Config, rows_per_file: int = 100_000) -> dict:
    spark = records.sparkSession
    files.put(spark, f"{directory}/{_CONFIG}", exports.pretty(config.snapshot()))
    lines = exports.record_json(records.select(*RECORD.names), "namespace", "case_id")
    files.write_lines(lines.withColumnRenamed("split", "group"), f"{directory}/splits", F.concat_ws("|", "namespace", "case_id"), F.col("case_id"), rows_per_file)
    found = files.scanned(spark, directory, "*.json*").filter(F.col("path") != _MANIFEST)
    manifest = {
        "schema_version": MANIFEST_VERSION, "generator_version": validation.GENERATOR_VERSION, "project": config.project_name, "seed": config.seed, "configuration_digest": config.digest,
        "generated_data_license": config.generated_data_license, "counts": counts(records), "files": {r.path: {"sha256": r.sha256, "bytes": r.bytes} for r in found.collect()},
        "determinism": {"lines": "UTF-8 JSON with sorted keys, ended by LF", "order": "a file has the rows whose case_id hashes to it, sorted by namespace", "values": "functions of the configuration and of a record's number"},
        "synthetic_holdout_limitation": HOLDOUT_LIMITATION,
    }
    files.put(spark, f"{directory}/{_MANIFEST}", exports.pretty(manifest))
    return manifest


def generated(spark: SparkSession, config: Config, directory: str) -> dict:
    """Generate a corpus into a folder; the manifest is returned."""
    return write(generate.generate(spark, config), directory, config)


def load(spark: SparkSession, directory: str) -> tuple[Config, DataFrame, dict]:
    """(configuration, records, manifest) of a corpus; a malformed line is an error that names file and line."""
    manifest = files.get_object(spark, f"{directory}/{_MANIFEST}")
    config = config_of(files.get_object(spark, f"{directory}/{_CONFIG}"))
    folders = [f"{directory}/splits/{s}" for s in SPLITS if files.exists(spark, f"{directory}/splits/{s}")]
    if not folders:
        return config, spark.createDataFrame([], RECORD), manifest
    external.refuse_malformed(spark, folders, external.RECORD_FIELDS)
    return config, external.read_records(spark, folders), manifest


def file_violations(spark: SparkSession, directory: str, config: Config, manifest: dict, records: DataFrame) -> DataFrame:
    """(code, split, case_id, message) of the rules on the manifest and its files."""
    found = []
    if manifest.get("schema_version") != MANIFEST_VERSION:
        found.append(("manifest_schema", None, "the manifest's schema is not supported"))
    if manifest.get("configuration_digest") != config.digest:
        found.append(("config_digest", None, "the configuration's digest is not the manifest's"))
    if manifest.get("generated_data_license") != config.generated_data_license:
        found.append(("data_license", None, "the manifest's data licence is not the configuration's"))
    version = manifest.get("generator_version")
    if not isinstance(version, str) or not version:
        found.append(("generator_version", None, "the manifest names no generator version"))
    if manifest.get("synthetic_holdout_limitation") is None:
        found.append(("claim_boundary", None, "the manifest omits the limitation of the held-out split"))
    own, told = counts(records), manifest.get("counts", {})
    found += [("manifest_counts", s, f"the manifest's counts of {s} are not those of its records") for s in sorted({*own, *told}) if own.get(s) != told.get(s)]
    declared = manifest.get("files", {})
    wanted = {_CONFIG, *(f"splits/{s}/part-00000.jsonl" for s, n in config.splits.items() if n), *declared}
    rows = [(p, declared.get(p, {}).get("sha256"), declared.get(p, {}).get("bytes")) for p in sorted(wanted)]
    expected = spark.createDataFrame(rows, "path string, want_sha256 string, want_bytes long")
    both = expected.join(files.scanned(spark, directory, "*.json*").filter(F.col("path") != _MANIFEST), "path", "full_outer")
    there = F.col("sha256").isNotNull()
    tests = [
        (~there, "missing_file"), (there & ~F.coalesce(F.col("sha256") == F.col("want_sha256"), F.lit(False)), "file_hash"), (there & ~F.coalesce(F.col("bytes") == F.col("want_bytes"), F.lit(False)), "file_size"),
        (there & (F.col("crlf") | (F.endswith("path", F.lit(".jsonl")) & ~F.col("ended"))), "stable_encoding"),
    ]
    damaged = both.select(F.explode(F.array_compact(F.array(*(F.when(t, F.lit(c)) for t, c in tests)))).alias("code"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("case_id"), F.col("path").alias("message"))
    return damaged.unionByName(spark.createDataFrame([(c, s, None, m) for c, s, m in found], "code string, split string, case_id string, message string"))


def violations(spark: SparkSession, directory: str) -> DataFrame:
    """(code, split, case_id, message): all rules on a corpus's files and records."""
    config, records, manifest = load(spark, directory)
    return file_violations(spark, directory, config, manifest, records).unionByName(validation.violations(records, config))


def validate(spark: SparkSession, directory: str) -> Report:
    """All rules; those on records are counted where the records are, and the first ``LISTED`` are listed."""
    with scope(spark):
        rows = violations(spark, directory)
        by_code = {r.code: r.n for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
        told = rows.orderBy("code", "split", "case_id", "message").limit(LISTED).collect() if by_code else []
    lines = [f"{r.code}: " + " ".join(x for x in (r.split, r.case_id, r.message) if x) for r in told]
    return Report(sum(by_code.values()), lines, {"by_code": by_code})


def _checked(spark: SparkSession, directory: str, forensic: bool) -> Report:
    report = validate(spark, directory)
    if not report.valid and not forensic:
        raise InvalidCorpus(report)
    return report


def audit_corpus(spark: SparkSession, directory: str, profile: str = "config", with_probe: bool | None = None, forensic: bool = False) -> list[audit.Finding]:
    """The audit of a corpus on disk. It is validated first; an invalid one is refused or, for forensics, cannot pass.

    Without ``with_probe`` the configuration says whether the probe runs.
    """
    report = _checked(spark, directory, forensic)
    config, records, _ = load(spark, directory)
    whole = audit.Finding("corpus_integrity", "PASS" if report.valid else "FAIL", report.count, report.count, 0, {"errors": report.errors[: audit.REPORTED]})
    with scope(spark):
        return [whole, *audit.audit(records, config, profile, config.probe if with_probe is None else with_probe)]


def reproduce(spark: SparkSession, directory: str) -> dict[str, bool]:
    """Which files of a corpus are the same, byte for byte, when it is generated again from its own configuration."""
    config, _, manifest = load(spark, directory)
    if manifest.get("generator_version") != validation.GENERATOR_VERSION:
        raise ValueError(f"the corpus is of generator version {manifest.get('generator_version')}, this one is {validation.GENERATOR_VERSION}; bytes are only the same within a version")
    again = f"{own_folder(spark)}/reproduced-{config.digest[:12]}"
    files.delete(spark, again)
    try:
        generated(spark, config, again)
        old = files.scanned(spark, directory, "*.json*").select("path", "sha256")
        new = files.scanned(spark, again, "*.json*").select("path", F.col("sha256").alias("again"))
        rows = old.join(new, "path", "full_outer").filter(F.col("path").isin(_CONFIG, _MANIFEST) | F.startswith("path", F.lit("splits/"))).collect()
    finally:
        files.delete(spark, again)
    return {r.path: r.sha256 is not None and r.sha256 == r.again for r in sorted(rows, key=lambda r: r.path)}


def export_corpus(spark: SparkSession, directory: str, kind: str, out: str | None = None, forensic: bool = False) -> dict:
    """Write a valid corpus in a format, with ``labels.json``, and say what was written."""
    if kind not in exports.FORMATS:
        raise ValueError(f"unknown format {kind}")
    report = _checked(spark, directory, forensic)
    config, records, _ = load(spark, directory)
    to = out or f"{directory.rstrip('/')}-exports/{kind}"
    if not files.is_empty(spark, to):
        raise ValueError("the output folder is not empty")
    exports.export(records, to, kind)
    names = sorted(x.name for x in config.labels)
    files.put(spark, f"{to}/labels.json", exports.pretty({"labels": names, "bio_tags": ["O", *(f"{p}-{n}" for n in names for p in "BI")]}))
    made = {r.path: r.sha256 for r in files.scanned(spark, to).collect() if not r.path.rpartition("/")[2].startswith(("_", "."))}
    return {"files": dict(sorted(made.items())), "format": kind, "integrity_valid": report.valid, "path": to, "records": records.count()}


def import_marked(spark: SparkSession, source: str, out: str, debug_local: bool = False) -> dict:
    """Import marked texts as unreviewed records; what the import found is returned and written beside them.

    The first malformed record stops the import. Its number is told, its text
    only with ``debug_local``.
    """
    if not files.is_empty(spark, out):
        raise ValueError("the output folder is not empty")
    numbered = external.marked_entries(spark, source)
    with scope(spark):
        entries = external.stored(numbered.withColumn("m", spans.parsed(F.col("marked"))), "marked")
        if not entries.limit(1).count():
            raise ValueError("the input has no records")
        bad = entries.filter("m.fault is not null or marked is null").orderBy("number").limit(1).collect()
        if bad:
            told = f"; its text is {bad[0].marked!r}" if debug_local else ""
            raise ValueError(f"record {bad[0].number} has invalid annotations: {bad[0].m.fault or 'no text'}{told}")
        rows = external.imported(entries)
        repeated = rows.groupBy("case_id").count().filter("count > 1").limit(1).count()
        if repeated:
            raise ValueError("the input has repeated records")
        # One file, as of one split that has no name yet.
        files.write_lines(exports.record_json(rows, "case_id").withColumn("group", F.lit("records")).drop("split"), out, F.col("case_id"), F.col("case_id"))
        unsafe = entries.select("number", safety.text_reasons(F.col("m.text")).alias("reasons")).filter(F.size("reasons") > 0)
        reasons = {r.reason: r["count"] for r in unsafe.select(F.explode("reasons").alias("reason")).groupBy("reason").count().collect()}
        flagged = [r.number for r in unsafe.orderBy("number").limit(FLAGGED).collect()]
        labels = {r.label: r["count"] for r in rows.select(F.explode("annotations.entity_type").alias("label")).groupBy("label").count().collect()}
        total = rows.count()
    manifest = {
        "schema_version": IMPORT_VERSION, "records": total, "labels": dict(sorted(labels.items())), "provenance": "human_supplied", "release_status": "unreviewed", "mixing_policy": MIXING_POLICY, "responsibility_warning": RESPONSIBILITY,
        "safety_findings": {"flagged_record_numbers": flagged, "reasons": dict(sorted(reasons.items()))}, "files": {r.path: {"sha256": r.sha256, "bytes": r.bytes} for r in files.scanned(spark, out, "*.jsonl").orderBy("path").collect()},
    }
    files.put(spark, f"{out}/import-manifest.json", exports.pretty(manifest))
    return manifest


def status(spark: SparkSession, directory: str) -> dict:
    """Manifest, validation and audit of a corpus, in short."""
    report = validate(spark, directory)
    _, _, manifest = load(spark, directory)
    findings = audit_corpus(spark, directory, forensic=True)
    return {
        "validation": report.to_dict(), "audit": {"status": audit.rollup(findings), "findings": [asdict(f) for f in findings]}, "limitation": HOLDOUT_LIMITATION,
        "manifest": {k: manifest.get(k) for k in ("configuration_digest", "counts", "generator_version", "seed")},
    }
