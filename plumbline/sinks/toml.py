"""Reports in TOML, for people; tables are written as Parquet. Rows come to the driver a partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row

from plumbline.plans.config import Config
from plumbline.plans.scoreboard import Run

VERSION = "1.1.0"


def collected(df: DataFrame, *order) -> Iterator[Row]:
    return df.orderBy(*order).toLocalIterator()


def text(x: str | None) -> str:
    return json.dumps(x or "", ensure_ascii=False)


def texts(xs: Iterable[str]) -> str:
    return "[" + ", ".join(map(text, xs)) + "]"


def number(x: float) -> str:
    """Six decimals, half to even as stored."""
    return f"{x:.6f}"


def scoreboard(run: Run, config: Config, generated_at: str, states: dict[str, str], generator: str = "plumbline", methodology: str = "") -> str:
    out = [f"schema_version = {text(VERSION)}", f"generated_at = {text(generated_at)}", f"generator = {text(generator)}", f"methodology = {text(methodology)}", ""]
    stats = {r.source_id: r for r in collected(run.stats, "source_id")}
    if not states:
        out += ["[sources]", ""]
    for source in sorted(states):
        r = stats.get(source)
        n = (r.n_rows, r.n_matched, r.n_unmatched) if r else (0, 0, 0)
        out += [f"[sources.{text(source)}]", f"status = {text(states[source])}", f"n_rows_ingested = {n[0]}", f"n_rows_matched = {n[1]}", f"n_rows_unmatched = {n[2]}", ""]
    roles = {"i_raw": "I_raw", "p_raw": "P_raw", "b_raw": "B_raw", "r": "R", "i_adj": "I_raw", "p_adj": "P_raw", "b_adj": "B_raw"}
    groups = sorted({*config.groups, *config.perspectives})
    metrics = sorted({*config.inputs(), *config.composites})
    for e in collected(run.entities, "entity", "display"):
        e = e.asDict()
        out += ["[[models]]", f"canonical_id = {text(e['entity'])}", f"display_name = {text(e['display'])}", f"vendor = {text(e['vendor'])}", 'thinking_effort = "default"', f"aliases = {texts(e['aliases'])}", f"sources = {texts(e['sources'])}", ""]
        out += ["[models.scores]", *[f"{k} = {number(e.get(c, 50.0))}" for k, c in roles.items()], ""]
        out += ["[models.groups]", *[f"{g} = {number(e[g])}" for g in groups], ""]
        out += ["[models.metrics]", *[f"{m} = {number(e[m])}" for m in metrics if e.get(m) is not None], ""]
        out += ["[models.missing]", "metrics = []", f"groups_shrunk = {texts(e['groups_shrunk'])}", ""]
    return "\n".join(out)


def missing(run: Run, generated_at: str) -> str:
    out = [f"generated_at = {text(generated_at)}", ""]
    for e in collected(run.entities.select("entity", "display", "groups_shrunk"), "entity"):
        out += [f"[models.{text(e.entity)}]", f"display_name = {text(e.display)}", "metrics = []", f"groups_shrunk = {texts(e.groups_shrunk)}", ""]
    return "\n".join(out)


def triage(unmatched: DataFrame, gaps: DataFrame, siblings: DataFrame, blocked: DataFrame, generated_at: str) -> str:
    """Unmatched names by source, and gaps of entities with the siblings that could fill them."""
    groups = list(collected(unmatched, "source_id", unmatched["count"].desc(), "name_norm"))
    stopped = {(r.entity, r.source_id) for r in collected(blocked, "entity")}
    near: dict[tuple[str, str], list[Row]] = {}
    for r in collected(siblings, "entity", "source_id", "nth"):
        near.setdefault((r.entity, r.source_id), []).append(r)
    missing_at = list(collected(gaps, "entity", "source_id"))
    out = [f"generated_at = {text(generated_at)}", "", "[summary]", f"total_unmatched_groups = {len(groups)}", f"total_synthesis_gaps = {len({r.entity for r in missing_at})}", f"total_cap_blocked = {len(stopped)}", ""]
    for g in groups:
        out += [f"[[sources.{text(g.source_id)}.unmatched]]", f"normalized = {text(g.name_norm)}", f"example_name = {text(g.example_name)}", f"vendor_hint = {text(g.vendor_norm)}", f"count = {g['count']}", f"sample_fields = {texts(g.sample_fields)}", ""]
    for m in missing_at:
        out += [f"[[gaps.{text(m.entity)}.missing_at]]", f"source = {text(m.source_id)}", f"cap_blocked = {str((m.entity, m.source_id) in stopped).lower()}"]
        out += [f"candidates = [{', '.join(f'{{ canonical_id = {text(s.sibling)}, overlap = {s.overlap} }}' for s in near.get((m.entity, m.source_id), []))}]", ""]
    return "\n".join(out)


def read_scores(content: str) -> dict[str, dict[str, float]]:
    """Role scores by entity of an earlier report; an unreadable one gives none."""
    import tomllib

    try:
        models = tomllib.loads(content).get("models", [])
        return {m["canonical_id"]: {k: float(x) for k, x in m["scores"].items()} for m in models}
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError):
        return {}
