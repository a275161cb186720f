"""One value for each (entity, metric) out of many sources' rows.

Rows are (source_id, seq, model_name, vendor_hint, fields, synthesized_from)
with the resolved ``entity``; ``fields`` maps names to texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import json_number
from plumbline.operators.effort import effort_rank, may_score, with_effort

#: Metrics that are never borrowed from a sibling (fixed value).
NOT_BORROWED = ("AI_canary_health",)
OVERRIDES = "overrides"


def eligible_cells(rows: DataFrame, registry: DataFrame, exceptions: list[dict] = ()) -> DataFrame:
    """(entity, metric, raw, source_id, seq, effort, is_synth): numeric fields of matched rows that may score."""
    vendors = registry.select("entity", "vendor")
    x = with_effort(rows.filter("entity is not null")).join(vendors, "entity")
    synth = F.col("synthesized_from").isNotNull()
    allowed = F.when(synth, may_score(F.col("effort"), F.col("source_id"), F.col("entity"), F.col("vendor"))).otherwise(may_score(F.col("effort"), F.col("source_id"), F.col("entity"), F.col("vendor"), list(exceptions)))
    cells = x.filter(allowed).select("entity", "source_id", "seq", effort_rank(F.col("effort")).alias("effort"), synth.alias("is_synth"), F.explode("fields").alias("metric", "text"))
    return cells.withColumn("raw", json_number(F.col("text"))).filter("raw is not null").filter(~F.col("is_synth") | ~F.col("metric").isin(*NOT_BORROWED)).drop("text")


def arbitrate(cells: DataFrame, overrides: str = OVERRIDES) -> DataFrame:
    """(entity, metric, raw, source_id, is_synth, is_override), one row for each cell.

    Measured values win over borrowed ones. Among measured ones the last source
    in order of name wins, within it the lowest effort, then the last row; among
    borrowed ones the first source and row.
    """
    real = F.struct(F.col("source_id").alias("a"), (-F.col("effort")).alias("b"), F.col("seq").alias("c"))
    picked = cells.groupBy("entity", "metric").agg(
        F.max_by(F.struct("raw", "source_id", "is_synth"), F.when(~F.col("is_synth"), real)).alias("m"),
        F.min_by(F.struct("raw", "source_id", "is_synth"), F.when(F.col("is_synth"), F.struct("source_id", "seq"))).alias("s"),
        F.bool_and("is_synth").alias("only_synth"),
    )
    one = F.when(F.col("only_synth"), F.col("s")).otherwise(F.col("m"))
    return picked.select("entity", "metric", one.alias("x")).select("entity", "metric", "x.raw", "x.source_id", "x.is_synth", (~F.col("x.is_synth") & (F.col("x.source_id") == overrides)).alias("is_override"))


def sources_of(rows: DataFrame) -> DataFrame:
    """(entity, sources): of measured rows alone, even where no value of them counts."""
    return rows.filter("entity is not null and synthesized_from is null").groupBy("entity").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def match_stats(rows: DataFrame) -> DataFrame:
    """(source_id, n_rows, n_matched, n_unmatched); n_rows leaves borrowed rows out, the others count them."""
    return rows.groupBy("source_id").agg(F.count_if(F.col("synthesized_from").isNull()).alias("n_rows"), F.count("entity").alias("n_matched"), F.count_if(F.col("entity").isNull()).alias("n_unmatched"))


def synthesis_dominant(cells: DataFrame, cap: float) -> DataFrame:
    """(entity, n_cells, n_synth, dominant): whether borrowed cells are over ``cap`` of all."""
    n = cells.groupBy("entity").agg(F.count("*").alias("n_cells"), F.count_if("is_synth").alias("n_synth"))
    return n.withColumn("dominant", F.col("n_synth") / F.col("n_cells") > F.lit(cap))


def stale_overrides(rows: DataFrame, overrides: str = OVERRIDES) -> DataFrame:
    """(entity, metric, others): hand-set metrics that other sources measure by now."""
    cells = rows.filter("entity is not null and synthesized_from is null").select("entity", "source_id", F.explode(F.map_keys("fields")).alias("metric"))
    sources = cells.groupBy("entity", "metric").agg(F.array_sort(F.collect_set("source_id")).alias("s"))
    others = F.array_remove("s", overrides)
    return sources.filter(F.array_contains("s", overrides) & (F.size("s") > 1)).select("entity", "metric", others.alias("others"))


def pick_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
