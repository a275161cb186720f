"""Sources over the network, from a server that stands in for all of them."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.sources import connector, json_sources, registry

ROWS = [{"row": {"model_name": f"m{k % 120}", "organization": "acme", "rating": 1000 + k, "category": "overall" if k % 3 else "coding"}} for k in range(250)]


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append(self.path)
            status, body = 200, None
            if url.path == "/rows" and q["config"] == "text":
                at, n = int(q["offset"]), int(q["length"])
                body = {"rows": ROWS[at : at + n], "num_rows_total": 250}
                status = 200 if self.headers.get("Authorization") == "Bearer s3cret" else 403
            elif url.path == "/rows" and q["config"] == "search":
                status, body = 501, {"error": "the dataset is currently locked"}
            elif url.path == "/rows":
                status, body = 404, {"error": "no such board"}
            elif url.path == "/first-rows":
                body = {"rows": [{"row": {"model_name": "m1", "organization": "acme", "rating": 7}}]}
            elif url.path == "/gso":
                body = {"models": [{"name": "é", "setting": "Opt@1", "score": 4}]}
            elif url.path in ("/models", "/evaluations"):
                body = {"/models": [{"id": "x", "displayName": "X One"}], "/evaluations": [{"datasetId": "v2_Semi_Private", "modelId": "x", "score": 0.25}]}[url.path]
            elif url.path == "/bad":
                body = {"models": "nothing"}
            else:
                status, body = 404, {}
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def addresses(at, boards='["text", "search"]'):
    return f"""
        [lmarena]
        boards = {boards}
        page = "{at}/rows?config={{board}}&offset={{offset}}&length={{length}}"
        locked = "{at}/first-rows?config={{board}}"
        header = "Authorization"
        prefix = "Bearer "
        secret = "HF_TOKEN"
        [gso]
        urls = ["{at}/gone", "{at}/gso"]
        [arc_agi]
        parts.models = ["{at}/models"]
        parts.evaluations = ["{at}/evaluations"]
        [sonar]
        urls = ["{at}/gone"]
        [livecodebench]
        urls = ["{at}/bad"]
    """


def rows_of(df):
    return sorted((r.seq, r.model_name, r.vendor_hint, tuple(sorted(r.fields.items()))) for r in df.collect())


def test_pages_are_partitions_and_read_like_one_payload(spark, server):
    at, asked = server
    asked.clear()
    pages = connector.load(spark, ["lmarena"], addresses(at), {"HF_TOKEN": "s3cret"}, pause=0).withColumn("task", F.spark_partition_id()).cache()
    got = {(r.part, r.page): (len(json.loads(r.value)["rows"]), r.task) for r in pages.collect()}
    assert {k: n for k, (n, _) in got.items()} == {("text", 0): 100, ("text", 1): 100, ("text", 2): 50, ("search", 0): 1}
    assert len({t for _, t in got.values()}) == 4
    assert sum("config=text&offset=100" in x for x in asked) == 1
    whole = json.dumps({"configs": {"text": [{"rows": ROWS}], "search": [{"rows": [{"row": {"model_name": "m1", "organization": "acme", "rating": 7}}]}]}})
    want = rows_of(json_sources.lmarena(spark.createDataFrame([(whole,)], "value string")))
    assert rows_of(json_sources.lmarena_boards(pages)) == want and len(want) == 80
    # the payload that is cached is another way to the same rows
    assert rows_of(json_sources.lmarena(connector.documents(pages).select("value"))) == want
    pages.unpersist()


def test_what_fails_fails_alone(spark, server):
    at, _ = server
    got = {(r.source_id, r.part): r.error for r in connector.load(spark, None, addresses(at, '["text", "none"]'), pause=0).collect()}
    assert "403" in got["lmarena", "text"] and "404" in got["lmarena", "none"] and "404" in got["sonar", ""]
    assert got["gso", ""] is None and got["arc_agi", "models"] is None
    assert connector.load(spark, ["nobody"], addresses(at)).count() == 0


def test_cache_and_command_line(spark, server, tmp_path, capsys):
    at, _ = server
    (tmp_path / "a.toml").write_text(addresses(at))
    (tmp_path / "aliases.toml").write_text('[models."acme/m1"]\nvendor = "acme"\n')
    (tmp_path / "token").write_text("s3cret\n")
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/sonar.json").write_text("{}")
    base = ["--cache", str(tmp_path / "cache"), "--aliases", str(tmp_path / "aliases.toml"), "--out", str(tmp_path / "out"), "--addresses", str(tmp_path / "a.toml"), "--pause", "0", "--hf-token-file", str(tmp_path / "token")]
    import os

    os.utime(tmp_path / "cache/sonar.json", (1, 1))
    assert cli.main(["fetch", *base, "--only", "lmarena,gso,arc_agi,sonar,swebench,artificial_analysis"], spark) == 0
    out = capsys.readouterr()
    assert dict(x.split("\t") for x in out.out.splitlines()) == {"lmarena": "fetched", "gso": "fetched", "arc_agi": "fetched", "sonar": "stale", "swebench": "missing", "artificial_analysis": "skipped"}
    assert "sonar" in out.err
    assert (tmp_path / "cache/gso.json").read_text() == json.dumps({"models": [{"name": "é", "setting": "Opt@1", "score": 4}]}, indent=2, ensure_ascii=False) + "\n"
    rows, states = registry.read(spark, str(tmp_path / "cache"), registry.chosen(["lmarena", "gso", "arc_agi"]))
    assert set(states.values()) == {"ok"} and {r.source_id: r["count"] for r in rows.groupBy("source_id").count().collect()} == {"lmarena": 80, "gso": 1, "arc_agi": 1}
    assert cli.main(["fetch", *base, "--only", "gso"], spark) == 0 and capsys.readouterr().out == "gso\tfresh\n"
    # every failing source is told, not just the first
    assert cli.main(["verify-sources", *base, "--only", "gso,sonar,livecodebench,arc_agi"], spark) == 1
    out = capsys.readouterr()
    assert "gso\tok\t1" in out.out and "arc_agi\tok\t1" in out.out and "sonar: " in out.err and "livecodebench: " in out.err
    assert cli.main(["verify-sources", *base, "--only", "gso"], spark) == 0
