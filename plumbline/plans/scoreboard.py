"""The whole run: rows of sources to scored, ranked and explained entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import arbitrate as a
from plumbline.operators import score as s
from plumbline.operators.cuts import cut
from plumbline.operators.match import resolve
from plumbline.operators.normalize import normalize
from plumbline.operators.synthesize import synthesize_chained
from plumbline.plans.config import Config

HEALTH = "AI_canary_health"


@dataclass
class Run:
    rows: DataFrame
    cells: DataFrame
    scores: DataFrame
    entities: DataFrame
    stats: DataFrame


def score_cells(cells: DataFrame, config: Config, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized cells, and one row for each entity: metrics, composites, perspectives, groups, roles."""
    defs = config.defs(cells.sparkSession)
    scores = cut(normalize(cells, defs, config.penalties.get("synthesis", 0.15), config.penalties.get("override_reported", 0.10)))
    table = s.wide(scores, sorted({*config.inputs(), HEALTH}))
    synth = scores.filter(F.col("metric") == HEALTH).select("entity", F.col("is_synth").alias("__health_synth"))
    df = registry.select("entity", "ord", "vendor", "display", "aliases").join(table, "entity", "left").join(synth, "entity", "left")
    # a level reads what the one before has made many times over: it is written, or the plan would repeat it each time
    df = s.add_level(cut(df), config.composites, config.band, missing=True)
    df = s.add_level(cut(df), config.perspectives | config.groups, config.band, shrunk=True, missing=True)
    df = cut(s.add_level(cut(df), config.roles, config.band, missing=True))
    p = config.penalties
    penalty = s.health_penalty(F.col(HEALTH), F.col("__health_synth"), p.get("canary_health_deadband", 60.0), p.get("canary_health_floor", 20.0), p.get("canary_max_role_penalty", 6.0))
    df = df.withColumn("penalty", penalty).withColumns({r: s.penalized(F.col(r), F.col("penalty")) for r in config.roles})
    # recorded while the means were made, united with what the columns alone tell
    shrunk, missing = F.array_sort(F.array_union(s.shrunk_names(df), s.recheck_shrunk(df.columns, config.groups, config.band))), s.missing_names(df)
    keep = [c for c in df.columns if not c.startswith("__") and not c.endswith(("__shrunk", "__missing"))]
    return scores, df.select(*keep, shrunk.alias("groups_shrunk"), missing.alias("missing_inputs"))


def run(rows: DataFrame, registry: DataFrame, pairs: DataFrame, config: Config) -> Run:
    matched = cut(resolve(rows, registry))
    every = cut(synthesize_chained(matched, pairs, registry, config.per_source_cap))
    cells = cut(a.arbitrate(a.eligible_cells(every, registry, config.exceptions)))
    scores, entities = score_cells(cells, config, registry)
    sources = a.sources_of(every)
    dominant = a.synthesis_dominant(cells, config.per_model_cap).select("entity", F.col("dominant").alias("synthesis_dominant"))
    entities = entities.join(sources, "entity", "left").join(dominant, "entity", "left")
    entities = entities.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("synthesis_dominant", F.coalesce("synthesis_dominant", F.lit(False)))
    return Run(every, cells, scores, entities, a.match_stats(every))
