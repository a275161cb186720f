"""Readers of HTML payloads, and of hand-set values in TOML."""

from __future__ import annotations

import math
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import parse_accuracy, unescape_once
from plumbline.functions.values import finite, number_like, once
from plumbline.operators import shapes
from plumbline.operators.arbitrate import pick_first
from plumbline.sources.html_tables import table_rows
from plumbline.sources.rows import SCHEMA, PayloadError, some, to_rows

# How the pages mark what is read.
ITEMS = '\\"items\\":['
PAIR = r'\\"model\\":\\"((?:(?!\\").)*)\\"(?=[^}]{0,588}?\\"score\\":([-0-9.]+))'
AGENTS = (("tools", 2), ("text", 1))
# End of the fixed values.


#: What decides where an array in escaped text ends.
MARKS = r'\\"|[\[\]]'


def items_array(html: Column, anchor: str = ITEMS) -> Column:
    r"""The array behind ``anchor``, up to its closing bracket, else NULL; brackets within texts, which ``\"`` opens and closes, don't count.

    Marks are taken out in order and followed with the depth that each leaves;
    the array is what stands up to the mark that leaves none.
    """
    tail = F.when(html.contains(anchor), F.substring(html, F.locate(anchor, html) + len(anchor) - 1, F.length(html)))

    def after(state: Column, mark: Column) -> Column:
        quote = mark == '\\"'
        step = F.when(quote | state["text"], 0).when(mark == "[", 1).otherwise(-1)
        moved = F.struct((state["marks"] + 1).alias("marks"), (state["depth"] + step).alias("depth"), (state["text"] != quote).alias("text"))
        return F.when(state["depth"] == 0, state).otherwise(moved)

    def cut_off(text: Column) -> Column:
        marks, between = F.regexp_extract_all(text, F.lit(f"({MARKS})"), F.lit(1)), F.split(text, MARKS)
        # the first mark is the opening bracket itself
        start = F.struct(F.lit(1).alias("marks"), F.lit(1).alias("depth"), F.lit(False).alias("text"))
        end = F.aggregate(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), start, after)
        whole = lambda n: F.array_join(F.zip_with(F.slice(between, 1, n), F.slice(marks, 1, n), lambda a, b: F.concat(a, b)), "")
        return once(end, lambda e: F.when(e["depth"] == 0, whole(e["marks"])))

    return once(tail, cut_off)


def swerebench(df: DataFrame) -> DataFrame:
    """Headline rates from an escaped array in a page; a model's agentic run stands before its plain one."""
    schema = "array<struct<modelName: string, agentVersion: string, taskRangeTimestamp: struct<from: bigint, to: bigint>, rangeStats: map<string,struct<resolvedRate: double>>>>"
    x = df.select(F.posexplode(F.from_json(unescape_once(items_array(F.col("value"))), schema)).alias("pos", "i"))
    stats = shapes.under(F.col("i.rangeStats"), F.col("i.taskRangeTimestamp.from"), F.col("i.taskRangeTimestamp.to"))
    priority = F.lit(0)
    for agent, p in AGENTS:
        priority = F.when(F.col("i.agentVersion") == agent, p).otherwise(priority)
    x = x.select("pos", F.col("i.modelName").alias("name"), priority.alias("p"), finite(stats["resolvedRate"]).alias("rate")).filter("name is not null and rate is not null")
    best = pick_first(x, ["name"], F.desc("p"), "pos")
    return some(to_rows(best, "swerebench", F.col("name"), None, {"SWERebench": F.col("rate")}, "name"), "swerebench")


def scored_pairs(df: DataFrame, metric: str, source_id: str) -> DataFrame:
    """Escaped model and score pairs of a page: the nearest score within the object; the first of a model counts."""
    found = F.arrays_zip(F.regexp_extract_all("value", F.lit(PAIR), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(PAIR), F.lit(2)).alias("score"))
    x = df.select(F.posexplode(found).alias("pos", "f")).select("pos", F.trim("f.name").alias("name"), finite(number_like(F.col("f.score"))).alias("score")).filter("name <> '' and score is not null")
    return some(to_rows(pick_first(x, ["name"], "pos"), source_id, F.col("name"), None, {metric: F.col("score")}, "pos"), source_id)


def mcp_atlas(df: DataFrame) -> DataFrame:
    return scored_pairs(df, "MCPAtlas", "mcp_atlas")


def swebench_pro(df: DataFrame) -> DataFrame:
    return scored_pairs(df, "SWEBenchPro", "swebench_pro")


def terminal_bench(df: DataFrame) -> DataFrame:
    """Rows of a table's body with eight cells: the fourth is the name, the eighth the accuracy."""
    x = table_rows(df).filter(F.size("cells") >= 8).select("line", F.col("cells")[3].alias("name"), parse_accuracy(F.col("cells")[7]).alias("score"))
    return to_rows(x.filter("name <> '' and score is not null"), "terminal_bench", F.col("name"), None, {"TerminalBench": F.col("score")}, "line")


def overrides_payload(df: DataFrame) -> DataFrame:
    """overrides() of a cached file, which is a person's list."""
    return overrides(df.sparkSession, "\n".join(r.value for r in df.collect()))


def overrides(spark: SparkSession, text: str) -> DataFrame:
    """Hand-set values, each with a note of where it comes from; the note isn't a field, as its words would tell of effort."""
    rows = []
    for i, e in enumerate(tomllib.loads(text).get("entries", [])):
        where = f"{e.get('canonical_id')}.{e.get('metric')}"
        if not str(e.get("metric", "")).strip() or not str(e.get("note", "")).strip() or not math.isfinite(e["value"]):
            raise PayloadError(f"overrides: {where} needs a metric, a note and a finite value")
        rows.append(("overrides", i, e["canonical_id"], None, {e["metric"]: repr(float(e["value"]))}, None))
    return spark.createDataFrame(rows, SCHEMA)
