"""Command line: fetch, score, render, triage, verify-sources, list-models, all.

    python -m plumbline.cli all --cache cache --aliases aliases.toml --out out
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import arbitrate, rank, synthesize
from plumbline.operators import triage as tri
from plumbline.operators.match import resolve
from plumbline.plans import config as c
from plumbline.plans.scoreboard import Run, run
from plumbline.sinks import tables, toml
from plumbline.sources import connector
from plumbline.sources import registry as reg
from plumbline.sources.rows import payloads


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("command", nargs="?", default="all", choices=["all", "fetch", "score", "render", "triage", "verify-sources", "list-models"])
    p.add_argument("--out", default="out")
    p.add_argument("--cache", default="cache")
    p.add_argument("--aliases", required=True, help="TOML of entities: models.<id> with vendor and aliases")
    p.add_argument("--pairs", help="TOML of sibling pairs")
    p.add_argument("--overrides", help="TOML of hand-set values")
    p.add_argument("--coefficients", help="TOML of weights instead of the built-in ones")
    p.add_argument("--only", default="", help="sources, comma-separated")
    p.add_argument("--prev", help="folder or report of an earlier run")
    p.add_argument("--now", help="RFC 3339 time of the report")
    p.add_argument("--min-count", type=int, default=1)
    p.add_argument("--offline", action="store_true")
    p.add_argument("--addresses", help="TOML of where sources are fetched, instead of the built-in one")
    p.add_argument("--pause", type=float, default=1.0, help="factor of all waits between requests")
    p.add_argument("--aa-api-key-file")
    p.add_argument("--openrouter-api-key-file")
    p.add_argument("--hf-token-file")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    read = lambda path: Path(path).read_text() if path else None
    registry = c.registry(spark, read(a.aliases))
    if a.command == "list-models":
        for r in toml.collected(registry, "entity"):
            print(f"{r.vendor}\t{r.entity}")
        return 0
    config = c.load(a.coefficients)
    now = dt.datetime.fromisoformat(a.now.replace("Z", "+00:00")) if a.now else dt.datetime.now(dt.UTC)
    stamp = now.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    sources = reg.chosen(a.only.split(","))
    files = {"ARTIFICIAL_ANALYSIS_API_KEY": a.aa_api_key_file, "OPENROUTER_API_KEY": a.openrouter_api_key_file, "HF_TOKEN": a.hf_token_file}
    secrets = {k: x for k, f in files.items() if (x := reg.secret(k, f))}
    if a.offline and a.command in ("fetch", "verify-sources"):
        print(f"{a.command} needs the network and doesn't go with --offline", file=sys.stderr)
        return 2
    if a.command in ("fetch", "all", "verify-sources") and not a.offline:
        complain = lambda x: print(f"warning: {x}", file=sys.stderr)
        got = connector.bring(spark, sources, a.cache, read(a.addresses), secrets, complain, pause=a.pause)
        for source, state in sorted(got.items()):
            print(f"{source}\t{state}")
    if a.command == "fetch":
        return 0
    if a.command == "verify-sources":
        return verify(spark, sources, a.cache, got)
    if a.command == "render":
        done, states = tables.read(spark, str(out / "tables"))
        return report(spark, done, states, config, a, out, stamp)
    rows, states = reg.read(spark, a.cache, sources, a.offline or a.command == "score", read(a.overrides), secrets)
    pairs = c.pairs(spark, read(a.pairs) or "")
    if a.command == "triage":
        matched = resolve(rows, registry)
        capped = synthesize.synthesize_chained(matched, pairs, registry, config.per_source_cap)
        free = synthesize.synthesize_chained(matched, pairs, registry, 1.0)
        gaps = tri.coverage_gaps(capped, registry)
        near = tri.siblings(gaps, capped.filter("entity is not null"), registry)
        (out / "triage.toml").write_text(toml.triage(tri.unmatched_groups(matched, a.min_count), gaps, near, synthesize.cap_blocked(capped, free), stamp))
        return 0
    tables.write(run(rows, registry, pairs, config), str(out / "tables"), states)
    done, states = tables.read(spark, str(out / "tables"))
    (out / "coefficients.toml").write_text(read(a.coefficients) or c.default_text())
    for r in arbitrate.stale_overrides(done.rows).collect():
        print(f"override of {r.entity} {r.metric} is also measured by {', '.join(r.others)}", file=sys.stderr)
    return report(spark, done, states, config, a, out, stamp)


def verify(spark: SparkSession, sources: list[reg.Source], folder: str, states: dict[str, str]) -> int:
    """Read each source apart, so that a bad payload is told with the others; skipped ones aren't failures."""
    failed = {}
    for s in sources:
        if states[s.id] == "missing" and s.id != "overrides":
            failed[s.id] = "nothing could be fetched"
        elif states[s.id] not in ("missing", "skipped"):
            try:
                n = s.read(payloads(spark, str(Path(folder, s.file)))).count()
                failed |= {} if n else {s.id: "no rows parsed"}
                print(f"{s.id}\tok\t{n}")
            except Exception as e:  # whatever a payload makes a reader do, the next source is still read
                failed[s.id] = str(e).splitlines()[0]
    for source, why in failed.items():
        print(f"{source}: {why}", file=sys.stderr)
    return int(bool(failed))


def report(spark: SparkSession, done: Run, states: dict[str, str], config: c.Config, a: argparse.Namespace, out: Path, stamp: str) -> int:
    """The reports of a stored run, and its leaderboard with the changes since an earlier one."""
    (out / "scoreboard.toml").write_text(toml.scoreboard(done, config, stamp, states))
    (out / "missing.toml").write_text(toml.missing(done, stamp))
    before = tables.earlier(spark, a.prev) if a.prev else None
    roles = list(config.roles)
    rank.deltas(done.entities.select("entity", *roles), before.select("entity", *roles) if before is not None else None, roles).join(
        rank.rank_for(rank.unpivot(done.entities.select("entity", *roles), roles), "role").select("entity", "role", "place", F.col("total")), ["entity", "role"]
    ).write.mode("overwrite").parquet(str(out / "tables/leaderboard"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
