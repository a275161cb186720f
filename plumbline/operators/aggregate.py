"""Weighted means that know what is missing.

Weights are summed in the order of their keys, by one fixed expression: a
shuffled sum would add the same numbers in another order from run to run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.values import clamp, finite, once, smoothstep

#: What stands for a score that nothing is known about, and below what a weight is none.
NEUTRAL, TINY = 50.0, 1e-12


@dataclass(frozen=True)
class Band:
    """Coverage at which a mean stops being pulled to the middle, and how wide the change is."""

    threshold: float = 0.70
    width: float = 0.20

    @property
    def cutoff(self) -> float:
        """Below it a mean counts as shrunk."""
        return min(max(self.threshold + self.width / 2, 0.0), 1.0)


def total(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


@dataclass(frozen=True)
class Mean:
    value: Column
    shrunk: Column
    missing: Column


def missing_safe_avg(columns: dict[str, Column], weights: dict[str, float], prefix: str = "", band: Band = Band()) -> Mean:
    """Weighted mean of what is present; the less is, the more it is pulled to 50.

    ``columns`` has a column for each key of ``weights`` that can be present;
    NULL, NaN and infinite values are missing.
    """
    keys = sorted(k for k, w in weights.items() if abs(w) < float("inf"))
    whole = 0.0
    for k in keys:
        whole += weights[k]
    if abs(whole) < TINY:
        return Mean(F.lit(NEUTRAL), F.lit(True), F.array().cast("array<string>"))
    x = {k: finite(columns[k]) if k in columns else F.lit(None).cast("double") for k in keys}
    weight = total(F.when(x[k].isNotNull(), weights[k]).otherwise(0.0) for k in keys)
    summed = total(F.coalesce(F.lit(weights[k]) * x[k], F.lit(0.0)) for k in keys)
    none = F.abs(weight) < TINY
    start = band.threshold - band.width / 2

    def of(known: Column) -> Column:
        mean, coverage = known["mean"], known["coverage"]
        pulled = mean * coverage + F.lit(NEUTRAL) * (F.lit(1.0) - coverage)
        part = once(clamp((coverage - F.lit(start)) / F.lit(band.width), 0.0, 1.0), smoothstep) if band.width > TINY else F.when(coverage >= band.threshold, 1.0).otherwise(0.0)
        return F.when(known["weight"] < TINY, NEUTRAL).otherwise(once(part, lambda u: clamp(pulled * (F.lit(1.0) - u) + mean * u, 0.0, 100.0)))

    parts = once(F.struct(weight.alias("weight"), summed.alias("summed")), lambda p: F.struct(
        F.abs(p["weight"]).alias("weight"),
        (p["summed"] / F.when(F.abs(p["weight"]) < TINY, 1.0).otherwise(p["weight"])).alias("mean"),
        (p["weight"] / F.lit(whole)).alias("coverage"),
    ))
    coverage, value = weight / F.lit(whole), once(parts, of)
    gaps = F.filter(F.array(*[F.when(x[k].isNull(), prefix + k) for k in keys]), lambda k: k.isNotNull())
    return Mean(value, none | (coverage < F.lit(band.cutoff)), gaps)
