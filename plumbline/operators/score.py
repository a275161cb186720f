"""From normalized metrics to composites, groups and roles, on one wide row for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import clamp
from plumbline.operators.aggregate import NEUTRAL, Band, Mean, missing_safe_avg

Weights = dict[str, dict[str, float]]


def wide(scores: DataFrame, metrics: list[str], value: str = "score") -> DataFrame:
    """One row for each entity with a column for each metric: absent cells are NULL."""
    return scores.groupBy("entity").agg(*[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m in sorted(metrics)])


def means(weights: Weights, band: Band = Band(), columns: dict[str, Column] | None = None) -> dict[str, Mean]:
    keys = {k for w in weights.values() for k in w}
    columns = columns if columns is not None else {k: F.col(k) for k in keys}
    return {name: missing_safe_avg(columns, w, f"{name}/", band) for name, w in weights.items()}


def add_level(df: DataFrame, weights: Weights, band: Band = Band(), shrunk: bool = False, missing: bool = False) -> DataFrame:
    """A column for each weighted mean; with ``shrunk`` and ``missing`` also what they were short of.

    An input without a column is missing. Every mean has a value, 50 where
    nothing is known, so the next level up finds it present.
    """
    made = means(weights, band, {c: F.col(c) for c in df.columns})
    out = df.withColumns({k: m.value for k, m in made.items()})
    extra = {}
    if shrunk:
        extra |= {f"{k}__shrunk": m.shrunk for k, m in made.items()}
    if missing:
        extra |= {f"{k}__missing": m.missing for k, m in made.items()}
    return out.withColumns(extra) if extra else out


def shrunk_names(df: DataFrame) -> Column:
    """Sorted names of the means that were pulled to the middle."""
    names = [c for c in sorted(df.columns) if c.endswith("__shrunk")]
    return F.array_sort(F.filter(F.array(*[F.when(F.col(c), c.removesuffix("__shrunk")) for c in names]).cast("array<string>"), lambda x: x.isNotNull()))


def missing_names(df: DataFrame) -> Column:
    names = [c for c in sorted(df.columns) if c.endswith("__missing")]
    return F.array_sort(F.flatten(F.array(*names))) if names else F.array().cast("array<string>")


def recheck_shrunk(columns: list[str], weights: Weights, band: Band = Band()) -> Column:
    """Names of groups whose present inputs, by columns alone, cover less than the cutoff."""
    found = []
    for name in sorted(weights):
        whole = sum(weights[name].values())
        if whole > 0:
            gone = F.lit(0.0)
            for k in sorted(weights[name]):
                gone = gone + (F.when(F.col(k).isNull(), weights[name][k]).otherwise(0.0) if k in columns else F.lit(weights[name][k]))
            found.append(F.when(F.lit(1.0) - gone / F.lit(whole) < band.cutoff, name))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def health_penalty(health: Column, is_synth: Column, deadband: float = 60.0, floor: float = 20.0, most: float = 6.0) -> Column:
    """Points off every role; none without a measured health or without a span."""
    span = deadband - floor
    if span <= 0:
        return F.lit(0.0)
    part = clamp((F.lit(deadband) - health) / F.lit(span), 0.0, 1.0)
    return F.when(~F.coalesce(is_synth, F.lit(False)), F.coalesce(part * most, F.lit(0.0))).otherwise(0.0)


def penalized(score: Column, penalty: Column) -> Column:
    return F.when(penalty > 0, clamp(score - penalty, 0.0, 100.0)).otherwise(score)


def neutral() -> Column:
    return F.lit(NEUTRAL)
