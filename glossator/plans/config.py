"""Corpus configuration: TOML or a mapping into checked, frozen values."""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from glossator.functions.safety import DOMAINS
from glossator.schema import SPLITS
from glossator.sources.exports import canonical

from .profiles import thresholds

ROLES, MODES = ("positive", "hard_negative"), ("prefix", "verifier", "either")


@dataclass(frozen=True)
class Label:
    name: str
    plugin: str
    cues: tuple[str, ...]
    morphology_group: str = "default"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Family:
    name: str
    plugin: str
    role: str
    weight: int = 1
    labels: tuple[str, ...] = ()
    templates: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    project_name: str
    seed: int
    positive_ratio: float
    minimum_hard_negative_ratio: float
    splits: dict[str, int]
    labels: tuple[Label, ...]
    families: tuple[Family, ...]
    diversity: dict[str, int]
    audit: dict[str, float]
    safety: dict
    personas: tuple[str, ...]
    organizations: tuple[str, ...]
    generated_data_license: str = "CC0-1.0"
    probe: bool = False

    @property
    def digest(self) -> str:
        return hashlib.sha256(canonical(asdict(self)).encode()).hexdigest()

    def snapshot(self) -> dict:
        """A mapping in the layout of the TOML file, from which :func:`config_of` makes an equal configuration."""
        audit = {k: v for k, v in self.audit.items() if not k.startswith("probe.")}
        return {
            "project_name": self.project_name, "seed": self.seed, "positive_ratio": self.positive_ratio, "minimum_hard_negative_ratio": self.minimum_hard_negative_ratio, "splits": dict(self.splits),
            "labels": [asdict(x) for x in self.labels], "families": [asdict(x) for x in self.families], "diversity": dict(self.diversity), "safety": dict(self.safety),
            "audit": audit | {"probe": {"enabled": self.probe} | {k.removeprefix("probe."): v for k, v in self.audit.items() if k.startswith("probe.")}},
            "surfaces": {"personas": list(self.personas), "organizations": list(self.organizations)}, "generated_data_license": self.generated_data_license,
        }

    def labels_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x.name, x.plugin, x.morphology_group, list(x.cues), x.options.get("preferred_shape")) for x in self.labels], "name string, plugin string, morphology_group string, cues array<string>, preferred_shape string")

    def families_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x.name, x.plugin, x.role) for x in self.families], "family string, plugin string, role string")


def part(pool, split: str) -> tuple:
    """A split's third of a pool: every third value in sorted order."""
    return tuple(sorted(pool)[SPLITS.index(split) :: 3])


def _need(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)


def config_of(raw: dict) -> Config:
    """Check a mapping in the layout of the TOML file."""
    labels = tuple(Label(x["name"], x["plugin"], tuple(x.get("cues", ())), x.get("morphology_group", "default"), dict(x.get("options", {}))) for x in raw.get("labels", ()))
    families = tuple(Family(x["name"], x.get("plugin", x["name"]), x["role"], x.get("weight", 1), tuple(x.get("labels", ())), tuple(x.get("templates", ()))) for x in raw.get("families", ()))
    names = {x.name for x in labels}
    _need(bool(labels) and len(names) == len(labels), "labels must be given and unique")
    for x in labels:
        _need(bool(re.fullmatch("[A-Z][A-Z0-9_]{1,63}", x.name)), f"label name {x.name} is malformed")
        _need(bool(x.cues), f"label {x.name} has no cue")
    _need(len({x.name for x in families}) == len(families), "families must be unique")
    for x in families:
        _need(bool(re.fullmatch("[a-z][a-z0-9_]{1,63}", x.name)), f"family name {x.name} is malformed")
        _need(x.role in ROLES and x.weight >= 1 and set(x.labels) <= names, f"family {x.name} has a wrong role, weight or label")
    _need({x.role for x in families} == set(ROLES), "each role needs a family")
    splits = raw["splits"]
    _need(set(splits) == set(SPLITS) and all(isinstance(n, int) and n > 0 for n in splits.values()), "all splits must be positive")
    ratio, least = raw["positive_ratio"], raw["minimum_hard_negative_ratio"]
    for r in (ratio, least):
        _need(isinstance(r, float) and 0 < r < 1, "ratios must be between 0 and 1")
    _need(1 - ratio >= least - 1e-12, "the positive ratio leaves too few hard negatives")
    _need(raw.get("seed", 0) >= 0, "the seed must not be negative")
    audit = dict(raw.get("audit", {}))
    # An older snapshot may still have a threshold that is no more.
    audit.pop("minimum_value_entropy_bits", None)
    probe = bool(dict(audit.get("probe", {})).get("enabled", False))
    audit |= {f"probe.{k}": v for k, v in audit.pop("probe", {}).items() if k != "enabled"}
    _need(audit.get("minimum_marker_support", 20) >= 2, "marker support must be at least 2")
    safety = {"reserved_email_domains": list(DOMAINS), "allowed_value_prefixes": ["SYN-", "synthetic "], "forbidden_terms": [], "mode": "either"} | raw.get("safety", {})
    _need(safety["mode"] in MODES, "unknown safety mode")
    _need(all(x.strip() for k in ("reserved_email_domains", "allowed_value_prefixes") for x in safety[k]), "empty safety prefix or domain")
    diversity = {"minimum_templates_per_family": 1, "minimum_personas_per_family": 1, "minimum_organizations_per_split": 1} | raw.get("diversity", {})
    _need(all(v >= 1 for v in diversity.values()), "diversity minimums must be at least 1")
    surfaces = raw.get("surfaces", {})
    pools = {k: tuple(surfaces.get(k, ())) for k in ("personas", "organizations")}
    for k, least_each in (("personas", "minimum_personas_per_family"), ("organizations", "minimum_organizations_per_split")):
        _need(len(set(pools[k])) == len(pools[k]) and all(pools[k]), f"{k} must be unique and not empty")
        _need(len(pools[k]) // 3 >= diversity[least_each], f"too few {k} for the splits")
    return Config(
        raw.get("project_name", "corpus"), raw.get("seed", 0), ratio, least, {s: splits[s] for s in SPLITS}, labels, families, diversity,
        thresholds(**{k.replace(".", "__"): v for k, v in audit.items()}), safety, pools["personas"], pools["organizations"], raw.get("generated_data_license", "CC0-1.0"), probe,
    )


def load(path: str | Path) -> Config:
    return config_of(tomllib.loads(Path(path).read_text()))
