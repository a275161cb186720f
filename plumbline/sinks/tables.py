"""Runs as tables that later runs read back."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import attr_values
from plumbline.plans.scoreboard import Run
from plumbline.sinks.toml import read_scores

MARKERS = ("http://", "https://", "//cdn", "data:")


def write(run: Run, folder: str, states: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    run.rows.write.mode(mode).partitionBy("source_id").parquet(f"{folder}/rows")
    run.cells.write.mode(mode).parquet(f"{folder}/cells")
    run.entities.write.mode(mode).parquet(f"{folder}/entities")
    run.stats.write.mode(mode).parquet(f"{folder}/stats")
    run.scores.write.mode(mode).parquet(f"{folder}/scores")
    run.entities.sparkSession.createDataFrame(sorted((states or {}).items()), "source_id string, status string").write.mode(mode).parquet(f"{folder}/states")


def read(spark: SparkSession, folder: str) -> tuple[Run, dict[str, str]]:
    """A run as it was written, and the states of its sources."""
    of = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Run(of("rows"), of("cells"), of("scores"), of("entities"), of("stats")), {r.source_id: r.status for r in of("states").collect()}


def earlier(spark: SparkSession, path: str) -> DataFrame | None:
    """(entity and roles) of an earlier run, from its tables or its report; None if there is none to read."""
    from pyspark.errors import AnalysisException

    if path.endswith(".toml"):
        roles = {"i_raw": "I_raw", "p_raw": "P_raw", "b_raw": "B_raw", "r": "R"}
        content = Path(path).read_text(errors="replace") if Path(path).is_file() else ""
        rows = [(e, *[scores.get(k) for k in roles]) for e, scores in read_scores(content).items()]
        return spark.createDataFrame(rows, "entity string, " + ", ".join(f"{r} double" for r in roles.values())) if rows else None
    folder = path
    try:
        return spark.read.parquet(f"{folder}/entities")
    except AnalysisException:
        return None


def normal_path(folder: Column, link: Column) -> Column:
    """``link`` from ``folder``, without . and ..; NULL if it leaves the root."""
    whole = F.when(link.startswith("/"), link).otherwise(F.concat(folder, F.lit("/"), link))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))

    def step(path: Column, x: Column) -> Column:
        up = F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))
        return F.when(x == "..", up).otherwise(F.concat(path, F.array(x)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def broken_pages(pages: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(path, problem) of HTML pages (path, html): references to elsewhere, and links whose target isn't a page."""
    scrubbed = F.col("html")
    for a in allowed:
        scrubbed = F.replace(scrubbed, F.lit(a), F.lit(""))
    outside = F.array(*[F.when(scrubbed.contains(m), f"contains {m}") for m in MARKERS])
    marked = pages.select("path", F.explode(F.filter(outside, lambda x: x.isNotNull())).alias("problem"))
    links = pages.select("path", F.explode(F.concat(attr_values(F.col("html"), "href"), attr_values(F.col("html"), "src"))).alias("link"))
    ok = F.lit(False)
    for a in allowed:
        ok = ok | (F.col("link") == a) | F.col("link").startswith(f"{a}/")
    inner = links.filter(~F.col("link").startswith("#") & ~ok).withColumn("link", F.substring_index("link", "#", 1)).filter("link <> ''")
    folder = F.regexp_replace("path", "[^/]*$", "")
    target = normal_path(folder, F.col("link"))
    known = pages.select(F.col("path").alias("target"))
    gone = inner.withColumn("target", target).join(known, "target", "left_anti")
    return marked.unionByName(gone.select("path", F.concat(F.lit("missing target "), "link").alias("problem")))
