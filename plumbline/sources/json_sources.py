"""Readers of JSON payloads. Numbers may come as numbers or as texts, so they are read as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import variants
from plumbline.functions.text import extract_model, vendor_of_id
from plumbline.functions.values import blended_cost, effort_priority, finite, first_number, json_number, mean_of_present, number_like, positive
from plumbline.operators import shapes
from plumbline.operators.arbitrate import pick_first
from plumbline.operators.history import incident_health, open_incident, worst
from plumbline.sources.rows import items, low_hint, named, some, to_rows

MILLION = 1_000_000.0


def openrouter(df: DataFrame) -> DataFrame:
    item = "struct<id: string, canonical_slug: string, name: string, created: string, context_length: string, top_provider: struct<context_length: string, max_completion_tokens: string>, pricing: struct<prompt: string, completion: string>, supported_parameters: array<string>>"
    x = items(df, f"data array<{item}>", "data")
    f = lambda name: F.col(f"item.{name}")
    name = F.coalesce(f("id"), f("canonical_slug"), f("name"))
    prompt, completion = number_like(f("pricing.prompt")), number_like(f("pricing.completion"))
    has = lambda *names: shapes.has_any(f("supported_parameters"), *names)
    fields = {
        "ModelId": f("id"),
        "CanonicalSlug": f("canonical_slug"),
        "DisplayName": f("name"),
        "Created": f("created"),
        "ContextWindow": first_number(f("context_length"), f("top_provider.context_length")),
        "MaxCompletionTokens": number_like(f("top_provider.max_completion_tokens")),
        "PromptPricePerMillion": prompt * MILLION,
        "CompletionPricePerMillion": completion * MILLION,
        "BlendedCost": blended_cost(prompt, completion) * MILLION,
        "SupportedParametersCount": F.nullif(F.size("item.supported_parameters"), F.lit(-1)),
        "SupportsTools": has("tools", "tool_choice"),
        "SupportsStructuredOutputs": has("structured_outputs", "response_format"),
        "SupportsReasoning": has("reasoning", "include_reasoning"),
    }
    return to_rows(x, "openrouter", name, vendor_of_id(name), fields, "pos")


def lmarena(df: DataFrame) -> DataFrame:
    """Ratings of a payload that holds all pages of all boards, or one page of the text board."""
    pages = "array<struct<rows: array<map<string,string>>>>"
    wrapped = F.from_json("value", f"configs map<string,{pages}>")["configs"]
    bare = F.create_map(F.lit("text"), F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), pages))
    x = df.select(F.explode(F.coalesce(wrapped, bare)).alias("config", "pages"))
    return arena(x.select("config", F.posexplode("pages").alias("page", "p")).select("config", "page", "p.rows"))


def lmarena_boards(pages: DataFrame) -> DataFrame:
    """lmarena() of (part, page, value) as the connector reads them, page by page: no payload is put together."""
    return arena(pages.select(F.col("part").alias("config"), "page", F.from_json("value", "rows array<map<string,string>>")["rows"].alias("rows")))


def arena(pages: DataFrame) -> DataFrame:
    """Ratings by (name, organisation) over all boards (config, page, rows); text fills two metrics, search and document one by their maximum."""
    x = pages.select("config", "page", F.posexplode("rows").alias("pos", "e"))
    # an entry is a row, or wraps one
    x = x.withColumn("r", F.coalesce(F.from_json(F.col("e")["row"], "map<string,string>"), "e"))
    r = lambda *keys: F.coalesce(*[F.col("r")[k] for k in keys])
    flat = x.select(
        "config",
        F.struct("config", "page", "pos").alias("at"),
        r("model_name", "model", "name").alias("name"),
        F.coalesce(r("organization", "creator"), F.lit("")).alias("org"),
        F.coalesce(r("category"), F.lit("overall")).alias("category"),
        *[number_like(r(k)).alias(k) for k in ("rating", "rank", "vote_count", "rating_lower", "rating_upper")],
    ).filter("category = 'overall'")
    last = lambda c, when=None: shapes.last(F.col(c), F.lit(True) if when is None else when, F.col("at"))
    own = lambda *configs: F.col("config").isin(*configs)
    g = flat.groupBy("name", "org").agg(
        last("rating", own("text")).alias("text"),
        shapes.first(F.col("rating"), own("text"), F.col("at")).alias("creative"),
        last("rating", own("webdev")).alias("code"),
        shapes.largest(F.col("rating"), own("search", "document")).alias("review"),
        *[last(c).alias(c) for c in ("rank", "vote_count", "rating_lower", "rating_upper")],
    )
    fields = {"LMArenaText": "text", "LMArenaCreativeOrOpenEnded": "creative", "CopilotArenaOrLMArenaCode": "code", "LMArenaSearchDocument": "review", "Rank": "rank", "VoteCount": "vote_count", "RatingLower": "rating_lower", "RatingUpper": "rating_upper"}
    return to_rows(g, "lmarena", F.col("name"), F.nullif("org", F.lit("")), {k: F.col(v) for k, v in fields.items()}, "name", "org")


def artificial_analysis(df: DataFrame) -> DataFrame:
    """Rows in rising order of intelligence; fractions become percents; zero speed and latency mean "not measured"."""
    item = "struct<slug: string, name: string, id: string, model_creator: map<string,string>, model_creators: map<string,string>, evaluations: map<string,string>, pricing: map<string,string>, timescaleData: map<string,string>, intelligence_index: string, intelligence: string, gpqa: string, hle: string, tau2: string, scicode: string, ifbench: string, lcr: string, artificial_analysis_coding_index: string, coding_index: string, coding: string, median_output_tokens_per_second: string, median_output_speed: string, median_time_to_first_token_seconds: string, median_ttft: string, price_1m_input_tokens: string, price_1m_output_tokens: string, price_1m_blended_3_to_1: string>"
    x = items(df, f"data array<{item}>", "data")
    f = lambda name: F.col(f"item.{name}")
    e = lambda name: f("evaluations")[name]
    p = lambda name: f("pricing")[name]
    percent = lambda name: first_number(e(name), f(name)) * 100.0
    prompt = first_number(p("input_price_per_million"), p("price_1m_input_tokens"), f("price_1m_input_tokens"))
    completion = first_number(p("output_price_per_million"), p("price_1m_output_tokens"), f("price_1m_output_tokens"))
    blend = mean_of_present(first_number(e("gpqa"), f("gpqa")), first_number(e("hle"), f("hle"))) * 100.0
    fields = {
        "ModelId": f("id"),
        "DisplayName": f("name"),
        "CanonicalSlug": f("slug"),
        "ArtificialAnalysisIntelligence": first_number(e("intelligence_index"), e("intelligence"), e("artificial_analysis_intelligence_index"), f("intelligence_index"), f("intelligence")),
        "ArtificialAnalysisReasoning": blend,
        "GPQA_HLE_Reasoning": blend,
        "Tau2Bench": percent("tau2"),
        "SciCode": percent("scicode"),
        "IFBench": percent("ifbench"),
        "LongContextRecall": percent("lcr"),
        "ArtificialAnalysisCoding": first_number(e("artificial_analysis_coding_index"), e("coding_index"), e("coding"), f("artificial_analysis_coding_index"), f("coding_index"), f("coding")),
        "OutputSpeed": positive(first_number(f("median_output_tokens_per_second"), f("median_output_speed"), f("timescaleData")["median_output_speed"])),
        "TTFT": positive(first_number(f("median_time_to_first_token_seconds"), f("median_ttft"), f("timescaleData")["median_time_to_first_chunk"])),
        "PromptPricePerMillion": prompt,
        "CompletionPricePerMillion": completion,
        "BlendedCost": F.coalesce(first_number(p("blended_price_per_million"), p("price_1m_blended_3_to_1"), p("blended_price"), p("blended"), f("price_1m_blended_3_to_1")), blended_cost(prompt, completion)),
    }
    order = F.coalesce(first_number(e("artificial_analysis_intelligence_index"), e("intelligence_index"), e("intelligence")), F.lit(0.0)).alias("by")
    return to_rows(x, "artificial_analysis", F.coalesce(f("slug"), f("name"), f("id")), F.coalesce(f("model_creator")["slug"], f("model_creators")["slug"]), fields, order, "pos")


# Metric, key of the reading, suite.
AXES = [
    ("AI_correctness", "correctness", "hourly"),
    ("AI_spec", "format", "hourly"),
    ("AI_code", "codeQuality", "hourly"),
    ("AI_efficiency", "efficiency", "hourly"),
    ("AI_stability", "stability", "hourly"),
    ("AI_refusal", "safety", "hourly"),
    ("AI_recovery", "debugging", "hourly"),
    ("AI_complexity", "complexity", "hourly"),
    ("AI_edge_cases", "edgeCases", "hourly"),
    ("AI_hallucination_resistance", "hallucinationRate", "deep"),
    ("AI_plan_coherence", "planCoherence", "deep"),
    ("AI_memory_retention", "memoryRetention", "deep"),
    ("AI_context_awareness", "contextAwareness", "tooling"),
    ("AI_task_completion", "taskCompletion", "tooling"),
    ("AI_tool_selection", "toolSelection", "tooling"),
    ("AI_parameter_accuracy", "parameterAccuracy", "tooling"),
]
# End of the fixed values.


def aistupidlevel(df: DataFrame) -> DataFrame:
    """The newest reading of each axis in its suite, in percent, and the health of canaries and open incidents."""
    inner = "modelScores: array<map<string,string>>, historyMap: map<string,array<struct<suite: string, axes: map<string,string>>>>, driftIncidents: array<struct<resolvedAt: string, modelId: string, modelName: string, metadata: map<string,string>>>"
    whole = F.from_json("value", f"struct<data: struct<{inner}>, {inner}>")
    data = df.select(F.coalesce(whole["data"], F.struct(*[whole[k].alias(k) for k in ("modelScores", "historyMap", "driftIncidents")])).alias("d"))
    # the payload is one document: its models look into its own map, so no join is needed
    x = data.select("d", F.posexplode("d.modelScores").alias("pos", "m"))
    x = x.withColumn("name", F.trim(F.coalesce(F.col("m")["name"], F.col("m")["model"]))).filter(named(F.col("name")))
    x = x.withColumn("id", F.coalesce(F.col("m")["id"], F.lit(""))).withColumn("h", F.coalesce(F.col("d.historyMap")[F.col("id")], F.col("d.historyMap")[F.col("name")]))

    def newest_reading(key: str, suite: str):
        read = lambda keep: F.try_element_at(F.filter(F.transform(F.filter("h", keep), lambda r: json_number(r["axes"][key])), lambda v: v.isNotNull()), F.lit(1))
        return F.coalesce(read(lambda r: r["suite"] == suite), read(lambda r: r["suite"].isNull()))

    mine = F.filter("d.driftIncidents", lambda i: open_incident(i["resolvedAt"], i["metadata"]["detectionMethod"]) & (F.coalesce(i["modelId"] == F.col("id"), F.lit(False)) | F.coalesce(F.lower(i["modelName"]) == F.lower("name"), F.lit(False))))
    incident = F.array_min(F.transform(mine, lambda i: incident_health(json_number(i["metadata"]["dropPercent"]))))
    canary = F.least(F.greatest(newest_reading("correctness", "canary") * 100.0, F.lit(0.0)), F.lit(100.0))
    canary = F.when(newest_reading("correctness", "canary").isNotNull(), canary)
    fields = {metric: newest_reading(key, suite) * 100.0 for metric, key, suite in AXES} | {"AI_canary_health": worst(canary, incident)}
    measured = F.coalesce(*fields.values()).isNotNull()
    score = F.coalesce(json_number(F.col("m")["currentScore"]), json_number(F.col("m")["score"]))
    fields["AI_correctness"] = F.when(measured, fields["AI_correctness"]).otherwise(score)
    x = x.filter(measured | score.isNotNull())
    return some(to_rows(x, "aistupidlevel", F.col("name"), low_hint(F.coalesce(F.col("m")["vendor"], F.col("m")["provider"])), fields, "pos"), "aistupidlevel")


def swebench(df: DataFrame, verified: tuple[str, ...] = ("Verified", "SWE-bench Verified"), multilingual: tuple[str, ...] = ("Multilingual", "SWE-bench Multilingual")) -> DataFrame:
    """The first board of each of two names; the first one must be there."""
    board = items(df, "leaderboards array<struct<name: string, results: array<struct<name: string, resolved: string>>>>", "leaderboards")
    out = None
    for nth, (names, metric) in enumerate(((verified, "SWEBenchVerified"), (multilingual, "SWEBenchMultilingual"))):
        first = shapes.first_of(board, F.trim("item.name"), names, "pos")
        if nth == 0:
            some(first, "swebench")
        r = first.select(F.posexplode("item.results").alias("at", "r")).withColumn("resolved", finite(number_like(F.col("r.resolved"))))
        r = r.filter(named(F.col("r.name")) & F.col("resolved").isNotNull()).select(F.lit(nth).alias("board"), "at", extract_model(F.col("r.name")).alias("name"), F.lit(metric).alias("metric"), "resolved")
        out = r if out is None else out.unionByName(r)
    fields = {m: F.when(F.col("metric") == m, F.col("resolved")) for m in ("SWEBenchVerified", "SWEBenchMultilingual")}
    return to_rows(out, "swebench", F.col("name"), None, fields, "board", "at")


def livecodebench(df: DataFrame) -> DataFrame:
    """The mean of each listed model's results."""
    schema = "models array<struct<model_repr: string>>, performances array<map<string,string>>"
    means = items(df, schema, "performances").select(F.col("item")["model"].alias("model"), finite(number_like(F.col("item")["pass@1"], trim=True)).alias("p"))
    models = items(df, schema, "models").filter(named(F.col("item.model_repr"))).select("pos", F.trim("item.model_repr").alias("model"))
    return to_rows(models.join(shapes.mean_by(means, "model", "p"), "model"), "livecodebench", F.col("model"), None, {"LiveCodeBench": F.col("p")}, "pos")


def gso(df: DataFrame) -> DataFrame:
    """Of a name's Opt@1 rows the one of the lowest effort; the score that controls for hacks stands before the plain one."""
    x, m = variants.items(df, "models"), F.col("item")
    # a present null blocks the plain score
    score = number_like(variants.first_present(m, "score_hack_control", "score").try_cast("string"))
    name = variants.at(m, "name").try_cast("string")
    x = x.filter((F.lower(variants.at(m, "setting").try_cast("string")) == "opt@1") & name.isNotNull()).select("pos", F.trim(name).alias("name"), finite(score).alias("score"), effort_priority(variants.at(m, "reasoning_effort").try_cast("string")).alias("effort")).filter("score is not null")
    return to_rows(pick_first(x, ["name"], "effort", "pos"), "gso", F.col("name"), None, {"GSO": F.col("score")}, "name")


def sonar(df: DataFrame) -> DataFrame:
    x = items(df, "models array<struct<name: string, organization: string, functionalSkill: string, issueDensity: string, bugDensityPerKloc: string, vulnerabilityDensityPerKloc: string>>", "models")
    n = lambda k: finite(number_like(F.col(f"item.{k}")))
    at_least_zero = lambda v: F.when(v >= 0, v)
    fields = {"SonarFunctionalSkill": n("functionalSkill"), "SonarIssueDensity": positive(n("issueDensity")), "SonarBugDensity": at_least_zero(n("bugDensityPerKloc")), "SonarVulnerabilityDensity": at_least_zero(n("vulnerabilityDensityPerKloc"))}
    x = x.filter(named(F.col("item.name")) & F.coalesce(*fields.values()).isNotNull())
    return some(to_rows(x, "sonar", F.trim("item.name"), low_hint(F.col("item.organization")), fields, "pos"), "sonar")


def arc_agi(df: DataFrame, dataset: str = "v2_Semi_Private") -> DataFrame:
    """Scores of one data set under display names; the first of a name counts."""
    schema = "models array<struct<id: string, displayName: string>>, evaluations array<struct<datasetId: string, modelId: string, score: string>>"
    shown = items(df, schema, "models").filter("item.id is not null and item.displayName is not null").groupBy(F.col("item.id").alias("modelId")).agg(F.max_by("item.displayName", "pos").alias("name"))
    e = items(df, schema, "evaluations").filter(F.col("item.datasetId") == dataset).select("pos", "item.modelId", finite(number_like(F.col("item.score"))).alias("score")).filter("modelId is not null and score is not null")
    x = shapes.shown_as(e, "modelId", shown, "name")
    return some(to_rows(pick_first(x, ["name"], "pos"), "arc_agi", F.col("name"), None, {"ARC_AGI_2": F.col("score") * 100.0}, "pos"), "arc_agi")
