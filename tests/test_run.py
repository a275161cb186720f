"""From payloads to reports by the command line, the site checks, and streams."""

import json
import tomllib

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.plans import config
from plumbline.sinks import tables, toml
from plumbline.streaming import readings

ALIASES = """
[models."acme/alpha-1"]
vendor = "Acme"
aliases = ["Alpha One"]
[models."acme/beta-2"]
vendor = "Acme"
[models."zeta/gamma-3"]
vendor = "z.ai"
"""
PAIRS = '[[pair]]\ntarget = "acme/beta-2"\nfrom = "acme/alpha-1"\n'
OVERRIDES = '[[entries]]\ncanonical_id = "zeta/gamma-3"\nmetric = "GSO"\nvalue = 12.5\nnote = "a card"\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("run")
    (f / "cache").mkdir()
    (f / "aliases.toml").write_text(ALIASES)
    (f / "pairs.toml").write_text(PAIRS)
    (f / "overrides.toml").write_text(OVERRIDES)
    put = lambda name, x: (f / "cache" / name).write_text(json.dumps(x))
    put("gso.json", {"models": [{"name": "Alpha One", "setting": "Opt@1", "score": 30}, {"name": "Nobody's model", "setting": "Opt@1", "score": 5}]})
    put("sonar.json", {"models": [{"name": "alpha-1", "organization": "acme", "functionalSkill": 80}, {"name": "gamma-3", "organization": "z.ai", "functionalSkill": 60}]})
    put("livecodebench.json", {"models": [{"model_repr": "beta-2"}], "performances": [{"model": "beta-2", "pass@1": 50}]})
    return f


def call(spark, folder, *more):
    base = ["--cache", str(folder / "cache"), "--aliases", str(folder / "aliases.toml"), "--pairs", str(folder / "pairs.toml"), "--overrides", str(folder / "overrides.toml"), "--out", str(folder / "out"), "--now", "2026-01-02T03:04:05Z", "--offline"]
    return cli.main([more[0], *base, *more[1:]], spark)


def test_all_then_render(spark, folder):
    assert call(spark, folder, "all") == 0
    report = (folder / "out/scoreboard.toml").read_text()
    board = tomllib.loads(report)
    assert board["generated_at"] == "2026-01-02T03:04:05Z" and board["schema_version"] == toml.VERSION
    models = {m["canonical_id"]: m for m in board["models"]}
    assert list(models) == sorted(models) and set(models) == {"acme/alpha-1", "acme/beta-2", "zeta/gamma-3"}
    assert models["acme/alpha-1"]["sources"] == ["gso", "sonar"] and models["zeta/gamma-3"]["sources"] == ["overrides", "sonar"]
    assert models["acme/beta-2"]["sources"] == ["livecodebench"] and "GSO" in models["acme/beta-2"]["metrics"]
    assert board["sources"]["gso"] == {"status": "ok", "n_rows_ingested": 2, "n_rows_matched": 2, "n_rows_unmatched": 1}
    assert board["sources"]["lmarena"]["status"] == "missing"
    # direct values are the population: 30 alone doesn't make one, so all three do
    assert models["acme/alpha-1"]["metrics"]["SonarFunctionalSkill"] == 100 and models["zeta/gamma-3"]["metrics"]["SonarFunctionalSkill"] == 0
    assert all(0 <= x <= 100 for m in models.values() for x in m["scores"].values())
    missing = tomllib.loads((folder / "out/missing.toml").read_text())
    assert set(missing["models"]) == set(models)
    assert tomllib.loads((folder / "out/coefficients.toml").read_text())["aggregation"]["trust_threshold"] == 0.70
    # what is stored is enough for the same reports, and an earlier report for the changes
    (folder / "prev.toml").write_text(report)
    assert call(spark, folder, "render", "--prev", str(folder / "prev.toml")) == 0
    assert (folder / "out/scoreboard.toml").read_text() == report
    board = spark.read.parquet(str(folder / "out/tables/leaderboard")).collect()
    assert len(board) == 12 and all(abs(r.score - r.previous) < 1e-6 for r in board) and {r.place for r in board} == {1, 2, 3}
    assert tables.earlier(spark, str(folder / "no.toml")) is None and tables.earlier(spark, str(folder / "nothing")) is None


def test_triage_sources_and_models(spark, folder, capsys):
    assert call(spark, folder, "triage") == 0
    t = tomllib.loads((folder / "out/triage.toml").read_text())
    [group] = t["sources"]["gso"]["unmatched"]
    assert group["example_name"] == "Nobody's model" and group["count"] == 1 and group["sample_fields"] == ["GSO=5.0"]
    assert {m["source"] for m in t["gaps"]["zeta/gamma-3"]["missing_at"]} == {"gso", "livecodebench"}
    assert t["summary"]["total_unmatched_groups"] == 1
    capsys.readouterr()
    assert call(spark, folder, "verify-sources") == 2 and call(spark, folder, "fetch") == 2
    assert call(spark, folder, "list-models") == 0 and capsys.readouterr().out.splitlines()[0] == "acme\tacme/alpha-1"


def test_coefficients_of_ones_own():
    mine = config.parse('[aggregation]\ntrust_threshold = 0.5\ntrust_transition_width = 0.1\n[penalties]\ncanary_max_role_penalty = 9.0\n[group_weights.G]\nM = 1.0\n[final_score_weights.R]\nG = 1.0\n[metrics.M]\nhigher_better = false\nlog_scale = false\ngroups = ["G"]\ntransform = "percentile"\n')
    assert mine.band.threshold == 0.5 and mine.penalties["canary_max_role_penalty"] == 9 and mine.inputs() == ["M"] and len(mine.exceptions) == len(config.load().exceptions) > 0
    with pytest.raises(ValueError):
        config.parse("[group_weights.G]\nM = 0.5\n")


def test_site_links(spark):
    page = lambda path, html: (path, html)
    pages = spark.createDataFrame(
        [page("index.html", '<a href="a/b.html"> <a href="#x"> <a href="/a/b.html#y"> <img src="gone.png"> https://ok.example/1'), page("a/b.html", '<a href="../index.html"> <a href="./b.html"> <a href="../../out.html"> <a href="https://ok.example/z">'), page("c.html", "<p>http://elsewhere</p>")],
        "path string, html string",
    )
    got = {(r.path, r.problem) for r in tables.broken_pages(pages, ["https://ok.example"]).collect()}
    assert got == {("index.html", "missing target gone.png"), ("a/b.html", "missing target ../../out.html"), ("c.html", "contains http://")}


def test_streams(spark, tmp_path):
    schema = "user string, suite string, value double, ts timestamp"
    rows = [("u", "deep", 1.0, "2026-01-01"), ("u", "deep", 2.0, "2026-01-03"), ("u", None, 5.0, "2026-01-02"), ("v", None, 7.0, "2026-01-01")]
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "user string, suite string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    newest = readings.newest_by_suite(stream, ["deep", "hourly"], ["user"])
    q = newest.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("newest").collect()} == {("u", 2.0, 5.0), ("v", 7.0, 7.0)}
    again = readings.recomputed(stream, lambda x: x.groupBy("user").agg(F.count("*").alias("n")), str(tmp_path / "t"), str(tmp_path / "o"), str(tmp_path / "c2"))
    again.trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {("u", 3), ("v", 1)}
