"""Each reader on a payload of its source's shape, fetching, and the states of sources."""

import json
import time

import pytest

from plumbline.sources import fetch, html_sources, json_sources, registry
from plumbline.sources.rows import SCHEMA, PayloadError


def read(spark, reader, payload):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    df = reader(spark.createDataFrame([(text,)], "value string"))
    assert df.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    rows = df.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [(r.model_name, r.vendor_hint, {k: float(v) if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v for k, v in r.fields.items()}) for r in rows]


def test_openrouter(spark):
    item = {"id": "acme/one", "canonical_slug": "acme/one-1", "name": "Acme: One", "context_length": 1000, "top_provider": {"max_completion_tokens": 50}, "pricing": {"prompt": "0.000001", "completion": "0.000002"}, "supported_parameters": ["tools", "seed"]}
    [(name, hint, f)] = read(spark, json_sources.openrouter, {"data": [item]})
    assert (name, hint) == ("acme/one", "acme") and f["ContextWindow"] == 1000 and f["PromptPricePerMillion"] == 1 and f["BlendedCost"] == pytest.approx(1.25)
    assert f["SupportsTools"] == "true" and f["SupportsReasoning"] == "false" and f["SupportedParametersCount"] == 2


def test_lmarena(spark):
    row = lambda name, rating, **more: {"row": {"model_name": name, "organization": "acme", "rating": rating, "category": "overall", **more}}
    got = read(spark, json_sources.lmarena, {"configs": {"text": [{"rows": [row("m", 1400, rank=2), {"row": {"model_name": "n", "rating": 1, "category": "coding"}}]}], "search": [{"rows": [row("m", 1200)]}], "document": [{"rows": [row("m", 1300)]}]}})
    assert [(n, h) for n, h, _ in got] == [("m", "acme")] and got[0][2]["LMArenaText"] == 1400 and got[0][2]["LMArenaSearchDocument"] == 1300
    assert read(spark, json_sources.lmarena, {"rows": [row("m", 1400)]})[0][2]["LMArenaCreativeOrOpenEnded"] == 1400


def test_artificial_analysis(spark):
    one = {"slug": "one", "model_creator": {"slug": "acme"}, "evaluations": {"artificial_analysis_intelligence_index": 50, "gpqa": 0.8, "hle": 0.2, "tau2": 0.5}, "median_output_tokens_per_second": 0, "pricing": {"price_1m_input_tokens": 1, "price_1m_output_tokens": 3}}
    two = {"slug": "two", "evaluations": {"artificial_analysis_intelligence_index": 40}, "median_output_tokens_per_second": 90}
    (a, _, fa), (b, hint, fb) = read(spark, json_sources.artificial_analysis, {"data": [one, two]})
    assert (a, b, hint) == ("two", "one", "acme") and fa["OutputSpeed"] == 90 and "OutputSpeed" not in fb
    assert fb["GPQA_HLE_Reasoning"] == 50 and fb["Tau2Bench"] == 50 and fb["BlendedCost"] == 1.5


def test_aistupidlevel(spark):
    history = [{"suite": "hourly", "axes": {"correctness": 0.9, "codeQuality": 0.5}}, {"suite": "hourly", "axes": {"correctness": 0.1}}, {"suite": "canary", "axes": {"correctness": 0.7}}]
    payload = {"data": {"modelScores": [{"id": "7", "name": "m", "provider": "Acme"}, {"id": "8", "name": "n", "currentScore": 66}, {"id": "9", "name": "gone"}], "historyMap": {"7": history}, "driftIncidents": []}}
    (m, hint, f), (n, _, g) = read(spark, json_sources.aistupidlevel, payload)
    assert (m, hint, n) == ("m", "acme", "n") and f["AI_correctness"] == 90 and f["AI_code"] == 50 and f["AI_canary_health"] == 70 and g == {"AI_correctness": 66}
    with pytest.raises(PayloadError):
        read(spark, json_sources.aistupidlevel, {"data": {"modelScores": [], "historyMap": {}, "driftIncidents": []}})


def test_swebench(spark):
    boards = [{"name": "Lite", "results": []}, {"name": "Verified", "results": [{"name": "Agent + One (2025-01-02)", "resolved": 50.5}, {"name": " ", "resolved": 1}]}, {"name": "Verified", "results": [{"name": "x", "resolved": 1}]}, {"name": "Multilingual", "results": [{"name": "Two", "resolved": "20"}]}]
    assert read(spark, json_sources.swebench, {"leaderboards": boards}) == [("One", None, {"SWEBenchVerified": 50.5}), ("Two", None, {"SWEBenchMultilingual": 20})]
    with pytest.raises(PayloadError):
        read(spark, json_sources.swebench, {"leaderboards": boards[:1]})


def test_livecodebench_gso_sonar_arc(spark):
    assert read(spark, json_sources.livecodebench, {"models": [{"model_repr": "a"}, {"model_repr": "b"}], "performances": [{"model": "a", "pass@1": 50}, {"model": "a", "pass@1": "70"}, {"model": "c", "pass@1": 1}]}) == [("a", None, {"LiveCodeBench": 60})]
    gso = [{"name": "a", "setting": "Opt@1", "score": 9, "score_hack_control": 5, "reasoning_effort": "high"}, {"name": "a", "setting": "opt@1", "score": 4, "reasoning_effort": "medium"}, {"name": "b", "setting": "Opt@10", "score": 3}, {"name": "c", "setting": "Opt@1", "score": 3, "score_hack_control": None}]
    assert read(spark, json_sources.gso, {"models": gso}) == [("a", None, {"GSO": 4})]
    sonar = [{"name": "a", "organization": "Acme", "functionalSkill": 80, "issueDensity": 0, "bugDensityPerKloc": 0}, {"name": "b"}]
    assert read(spark, json_sources.sonar, {"models": sonar}) == [("a", "acme", {"SonarFunctionalSkill": 80, "SonarBugDensity": 0})]
    arc = {"models": [{"id": "x", "displayName": "X One"}], "evaluations": [{"datasetId": "v2_Semi_Private", "modelId": "x", "score": 0.25}, {"datasetId": "v2_Semi_Private", "modelId": "y", "score": 0.5}, {"datasetId": "v1", "modelId": "z", "score": 1}]}
    assert read(spark, json_sources.arc_agi, arc) == [("X One", None, {"ARC_AGI_2": 25}), ("y", None, {"ARC_AGI_2": 50})]


def test_table_rows(spark):
    """Any order of attributes, nesting, references, elements that aren't closed; rows of heads and of other tables don't count."""
    from plumbline.sources.html_tables import table_rows

    tr, td = '<tr data-slot="table-row">', '<td data-slot="table-cell">'
    pages = [
        f"""<table data-slot="table"><thead>{tr}{td}head</td></tr></thead><tbody>{tr}<td class="x" data-slot='table-cell'>a &amp; <b>b</b>&nbsp; c</td>{td}2</td><td>other</td></tr><tr>{td}no row</td></tr></tbody></table>""",
        f'<table>{tr}{td}no</td></tr></table><table data-slot="table">{tr}{td}one{td}two{tr}{td}three</table>',
        f'<table data-slot="table"><tbody>{tr}{td}out <table><tbody>{tr}{td}in</td></tr></tbody></table> side</td></tr></tbody></table>',
        None,
    ]
    df = spark.createDataFrame([(p,) for p in pages], "value string")
    assert sorted(tuple(r.cells) for r in table_rows(df).collect()) == sorted([("a & b c", "2"), ("one", "two"), ("three",), ("out in side", "in"), ("in",)])


def test_arrays_in_escaped_text(spark):
    from pyspark.sql import functions as F

    pages = ['x\\"items\\":[1,[2],\\"]\\"] y]', 'x\\"items\\":[1', None, "none", '\\"items\\":[]x', '\\"items\\":[' + ',[\\"a]\\"]' * 50_000 + "] tail]"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.found for r in df.select("i", html_sources.items_array(F.col("html")).alias("found")).collect()}
    assert got == {0: '[1,[2],\\"]\\"]', 1: None, 2: None, 3: None, 4: "[]", 5: pages[5][len('\\"items\\":') : -len(" tail]")]}


def test_pages(spark):
    pair = lambda m, s: rf'{{\"model\":\"{m}\",\"x\":1,\"score\":{s}}}'
    page = "<script>" + pair("A", 50.5) + "," + pair("B", 40) + "," + pair("A", 1) + "</script>"
    assert read(spark, html_sources.mcp_atlas, page) == [("A", None, {"MCPAtlas": 50.5}), ("B", None, {"MCPAtlas": 40})]
    assert [f for _, _, f in read(spark, html_sources.swebench_pro, page)] == [{"SWEBenchPro": 50.5}, {"SWEBenchPro": 40}]
    item = lambda n, agent, rate: {"modelName": n, "agentVersion": agent, "taskRangeTimestamp": {"from": 1, "to": 2}, "rangeStats": {"1:2": {"resolvedRate": rate}}}
    escaped = json.dumps([item("m ]", "text", 10.5), item("m ]", "tools", 20.5)], separators=(",", ":")).replace('"', '\\"')
    assert read(spark, html_sources.swerebench, f'x \\"items\\":{escaped}, tail') == [("m ]", None, {"SWERebench": 20.5})]
    cell = '<td data-slot="table-cell">{}</td>'
    line = '<tr data-slot="table-row">' + "".join(cell.format(x) for x in ("1", "", "agent", "<b>One</b>", "", "", "", "82.0% ± 2.2")) + "</tr>"
    assert read(spark, html_sources.terminal_bench, f'<table data-slot="table"><tbody>{line}<tr data-slot="table-row">{cell}</tr></tbody></table>') == [("One", None, {"TerminalBench": 82})]


def test_overrides(spark):
    good = '[[entries]]\ncanonical_id = "a/b"\nmetric = "M"\nvalue = 3\nnote = "high effort, from a card"\n'
    [r] = html_sources.overrides(spark, good).collect()
    assert (r.source_id, r.model_name, r.fields) == ("overrides", "a/b", {"M": "3.0"})
    for bad in (good.replace("high effort, from a card", " "), good.replace("3", "inf"), good.replace('"M"', '""')):
        with pytest.raises(PayloadError):
            html_sources.overrides(spark, bad)


def test_states_and_secrets(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("ARTIFICIAL_ANALYSIS_API_KEY", raising=False)
    assert [s.id for s in registry.chosen([" gso ", "", "overrides"])] == ["gso", "overrides"] and len(registry.chosen(None)) == 14
    with pytest.raises(ValueError):
        registry.chosen(["nothing"])
    one = next(s for s in registry.SOURCES if s.id == "artificial_analysis")
    assert registry.status(one, str(tmp_path), False) == "skipped" and registry.status(one, str(tmp_path), True) == "missing"
    assert registry.status(one, str(tmp_path), False, {"ARTIFICIAL_ANALYSIS_API_KEY": "k"}) == "missing"
    (tmp_path / one.file).write_text("{}")
    assert one.fresh(str(tmp_path)) and not one.fresh(str(tmp_path), time.time() + 2 * 86400) and not one.fresh(str(tmp_path), time.time() - 100)
    (tmp_path / "key").write_text(" abc \nmore")
    monkeypatch.setenv("HF_TOKEN", " env ")
    assert registry.secret("HF_TOKEN", str(tmp_path / "key")) == "abc" and registry.secret("HF_TOKEN") == "env" and registry.secret("NOT_SET_HERE") is None
    (tmp_path / "gso.json").write_text(json.dumps({"models": [{"name": "a", "setting": "Opt@1", "score": 4}]}))
    rows, states = registry.read(spark, str(tmp_path), registry.chosen(["gso", "sonar"]))
    assert states == {"gso": "ok", "sonar": "missing"} and rows.count() == 1


def test_fetching():
    waits, asked = [], []

    def ask(url):
        asked.append(url)
        if "busy" in url and len(asked) < 3:
            return 429, {"Retry-After": "7"}, b""
        return (404, {}, b"") if "gone" in url else (200, {}, b"body")

    get = lambda url: fetch.with_retries(ask, url, waits.append)
    assert fetch.first_that_answers(get, ["http://gone", "http://busy"]) == b"body"
    assert waits == [7.0] and asked == ["http://gone", "http://busy", "http://busy"]
    with pytest.raises(fetch.FetchError, match="404"):
        fetch.first_that_answers(get, ["http://gone"])
    with pytest.raises(fetch.FetchError):
        fetch.with_retries(lambda u: (503, {}, b""), "http://x", waits.append)
    assert waits[1:] == [0.5, 1, 2, 4, 8, 16]
