"""All sources: reader, cached file, time to live, secret; and reading them from a cache folder."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import html_sources as h
from plumbline.sources import json_sources as j
from plumbline.sources.rows import SCHEMA, payloads

HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Source:
    id: str
    read: Callable[[DataFrame], DataFrame]
    file: str
    ttl: int = DAY
    secret: str | None = None

    def fresh(self, folder: str, now: float | None = None) -> bool:
        """Whether the cached file is younger than its time to live; one from the future isn't."""
        path = Path(folder, self.file)
        age = (time.time() if now is None else now) - path.stat().st_mtime if path.exists() else -1
        return 0 <= age < self.ttl


# Sources in the order of their registration.
SOURCES = [
    Source("openrouter", j.openrouter, "openrouter_models.json"),
    Source("lmarena", j.lmarena, "lmarena_overall.json"),
    Source("artificial_analysis", j.artificial_analysis, "artificial_analysis_llms.json", secret="ARTIFICIAL_ANALYSIS_API_KEY"),
    Source("aistupidlevel", j.aistupidlevel, "aistupidlevel_dashboard.json", HOUR),
    Source("swebench", j.swebench, "swebench_leaderboards.json", 7 * DAY),
    Source("swebench_pro", h.swebench_pro, "swebench_pro.html", 7 * DAY),
    Source("swerebench", h.swerebench, "swerebench.html", 7 * DAY),
    Source("livecodebench", j.livecodebench, "livecodebench.json", 2 * DAY),
    Source("gso", j.gso, "gso.json", 2 * DAY),
    Source("terminal_bench", h.terminal_bench, "terminal_bench.html", 7 * DAY),
    Source("sonar", j.sonar, "sonar.json", 7 * DAY),
    Source("mcp_atlas", h.mcp_atlas, "mcp_atlas.html", 7 * DAY),
    Source("arc_agi", j.arc_agi, "arc_agi.json", 7 * DAY),
    Source("overrides", h.overrides_payload, "score_overrides.toml", 7 * DAY),
]
# End of the fixed values.


def chosen(only: Iterable[str] | None, sources: list[Source] = SOURCES) -> list[Source]:
    """Sources named in ``only``, blanks around names aside; all without any name."""
    names = {x.strip() for x in only or [] if x.strip()}
    if unknown := names - {s.id for s in sources}:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    return [s for s in sources if not names or s.id in names]


def secret(name: str, file: str | None = None) -> str | None:
    """The first line of a file, or else the environment's value; blanks count as nothing, a missing file is an error."""
    line = next(iter(Path(file).read_text().splitlines()), "").strip() if file else ""
    return line or os.environ.get(name, "").strip() or None


def status(source: Source, folder: str, offline: bool, secrets: dict[str, str] | None = None) -> str:
    """ok, skipped (no secret to fetch with) or missing (nothing cached)."""
    cached = Path(folder, source.file).exists()
    if not offline and source.secret and not (secrets or os.environ).get(source.secret) and not source.fresh(folder):
        return "skipped"
    return "ok" if cached else "missing"


def read(spark: SparkSession, folder: str, sources: list[Source] = SOURCES, offline: bool = True, overrides: str | None = None, secrets: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Rows of all sources with a cached payload, and the status of each."""
    states = {s.id: status(s, folder, offline, secrets) for s in sources}
    rows = spark.createDataFrame([], SCHEMA)
    for s in sources:
        if s.id == "overrides" and overrides is not None:
            rows, states[s.id] = rows.unionByName(h.overrides(spark, overrides)), "ok"
        elif states[s.id] == "ok":
            rows = rows.unionByName(s.read(payloads(spark, str(Path(folder, s.file)))))
    return rows, states
