"""Configuration: weights, curves, penalties and caps, from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.text import VENDORS
from plumbline.operators.aggregate import Band

TRANSFORMS = ("percentile", "tail_penalty", "as_score")
#: Metrics that are normalized without standing in any weight table (fixed values).
UNWEIGHTED = ("AI_refusal", "LiveCodeBench")
REGISTRY = "entity string, ord int, vendor string, display string, aliases array<string>"
PAIRS = "pair_idx long, target string, donor string"


@dataclass
class Config:
    perspectives: dict[str, dict[str, float]] = field(default_factory=dict)
    composites: dict[str, dict[str, float]] = field(default_factory=dict)
    groups: dict[str, dict[str, float]] = field(default_factory=dict)
    roles: dict[str, dict[str, float]] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)
    exceptions: list[dict] = field(default_factory=list)
    band: Band = Band()
    penalties: dict[str, float] = field(default_factory=dict)
    per_model_cap: float = 0.55
    per_source_cap: float = 0.55

    def __post_init__(self):
        for level in ("perspectives", "composites", "groups", "roles"):
            for name, weights in getattr(self, level).items():
                if abs(sum(weights.values()) - 1) > 1e-9:
                    raise ValueError(f"weights of {level}.{name} sum to {sum(weights.values())}")
        for name, d in self.metrics.items():
            if d.get("transform", "percentile") not in TRANSFORMS:
                raise ValueError(f"{name} has an unknown transform")
        nested = set(self.composites) & {k for w in self.composites.values() for k in w}
        if nested:
            raise ValueError(f"composites of composites: {sorted(nested)}")

    def inputs(self) -> list[str]:
        """Names of all metrics that are normalized."""
        named = {k for level in (self.perspectives, self.composites, self.groups) for w in level.values() for k in w}
        return sorted((named | set(self.metrics)) - set(self.composites))

    def defs(self, spark: SparkSession) -> DataFrame:
        """(metric, higher_better, log_scale, transform)."""
        rows = []
        for m in sorted({*self.inputs(), *UNWEIGHTED}):
            d = self.metrics.get(m, {})
            rows.append((m, d.get("higher_better", True), d.get("log_scale", False), d.get("transform", "percentile")))
        return spark.createDataFrame(rows, "metric string, higher_better boolean, log_scale boolean, transform string")


def parse(text: str) -> Config:
    raw = tomllib.loads(text)
    synthesis, aggregation = raw.get("synthesis", {}), raw.get("aggregation", {})
    # a file that names no exceptions has the usual ones
    exceptions = raw["exceptions"] if "exceptions" in raw else tomllib.loads(default_text())["exceptions"]
    return Config(
        perspectives=raw.get("ai_stupid_perspective_weights", {}),
        composites=raw.get("composite_metrics", {}),
        groups=raw.get("group_weights", {}),
        roles=raw.get("final_score_weights", {}),
        metrics=raw.get("metrics", {}),
        exceptions=exceptions,
        band=Band(aggregation.get("trust_threshold", 0.70), aggregation.get("trust_transition_width", 0.20)),
        penalties=raw.get("penalties", {}),
        per_model_cap=synthesis.get("per_model_cap", 0.55),
        per_source_cap=synthesis.get("per_source_cap", 0.55),
    )


def default_text() -> str:
    return Path(__file__).with_name("defaults.toml").read_text()


def load(path: str | None = None) -> Config:
    return parse(Path(path).read_text() if path else default_text())


def vendor_of(name: str) -> str:
    low = name.lower()
    return next((v for v, others in VENDORS.items() if low == v or low in others), low)


def registry(spark: SparkSession, text: str) -> DataFrame:
    """Entities of a TOML table ``models``, in the order of their ids."""
    models = tomllib.loads(text).get("models", {})
    rows = [(k, i, vendor_of(m["vendor"]), k.split("/")[-1], sorted(set(m.get("aliases", [])))) for i, (k, m) in enumerate(sorted(models.items()))]
    return spark.createDataFrame(rows, REGISTRY)


def pairs(spark: SparkSession, text: str) -> DataFrame:
    """Sibling pairs of a TOML array ``pair`` of target and from, in their order."""
    return spark.createDataFrame([(i, p["target"], p["from"]) for i, p in enumerate(tomllib.loads(text).get("pair", []))], PAIRS)
