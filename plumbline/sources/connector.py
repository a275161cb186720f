"""Sources over the network as a Spark data source: one partition for each page of each board, each part and each plain source.

    connector.register(spark)
    spark.read.format("boards").option("addresses", toml).option("only", "lmarena,gso").load()

gives (source_id, kind, part, page, value, error), kind one of plain, part, board. A board's first page says how many
rows it has; it is asked for while the read is planned and goes along with its
partition, all other pages are fetched by tasks, in parallel. If a board's first
page is locked, its other data set is read instead. Busy servers are asked again
(``fetch.with_retries``), of several addresses the first that answers counts.
What can't be had is a row with an ``error``, so one source fails alone.
Secrets are options: ``secret.<name of the secret>``.
"""

from __future__ import annotations

import json
import time
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.fetch import FetchError, answer, first_that_answers, with_retries

SCHEMA = "source_id string, kind string, part string, page long, value string, error string"
#: Rows of a page (fixed value).
PAGE = 100
#: What a server says of a data set that can't be read by pages now (fixed values).
LOCKED = ("LockedDatasetTimeoutError", "dataset is currently locked", "status 501")


def built_in() -> str:
    return Path(__file__).with_name("addresses.toml").read_text()


@dataclass
class Asked(InputPartition):
    """One address to ask, or what it has answered already."""

    source: str
    kind: str
    part: str
    page: int
    urls: list[str]
    headers: dict[str, str] = field(default_factory=dict)
    body: str | None = None
    error: str | None = None

    def __post_init__(self):
        self.value = (self.source, self.kind, self.part, self.page)


def ask(urls: list[str], headers: dict[str, str], pause: float = 1.0) -> str:
    """The first body of several addresses; ``pause`` shortens or lengthens all waits."""
    one = lambda url: with_retries(lambda u: answer(u, headers), url, lambda s: time.sleep(s * pause))
    return first_that_answers(one, urls).decode("utf-8", "replace")


class BoardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.addresses = tomllib.loads(options.get("addresses") or built_in())
        self.only = {x.strip() for x in options.get("only", "").split(",") if x.strip()}
        self.length, self.pause = int(options.get("length", PAGE)), float(options.get("pause", 1.0))
        self.secrets = {k.lower(): v for k, v in options.items() if k.lower().startswith("secret.")}

    def headers(self, at: dict) -> dict[str, str]:
        secret = self.secrets.get(f"secret.{at.get('secret', '')}".lower())
        return {at["header"]: at.get("prefix", "") + secret} if secret and "header" in at else {}

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source, at in self.addresses.items():
            if self.only and source not in self.only:
                continue
            headers = self.headers(at)
            if "urls" in at:
                out.append(Asked(source, "plain", "", 0, at["urls"], headers))
            out += [Asked(source, "part", part, 0, urls, headers) for part, urls in at.get("parts", {}).items()]
            for board in at.get("boards", []):
                out += self.pages(source, board, at, headers)
        return out or [Asked("", "", "", 0, [])]

    def pages(self, source: str, board: str, at: dict, headers: dict[str, str]) -> list[InputPartition]:
        url = lambda offset, length: at["page"].format(board=board, offset=offset, length=length)
        try:
            first = ask([url(0, self.length)], headers, self.pause)
            page = json.loads(first)
            here, total = len(page["rows"]), next((page[k] for k in ("num_rows_total", "num_rows") if page.get(k) is not None), len(page["rows"]))
        except FetchError as e:
            if "locked" in at and any(x in str(e) for x in LOCKED):
                return [Asked(source, "board", board, 0, [at["locked"].format(board=board)], headers)]
            return [Asked(source, "board", board, 0, [], error=str(e))]
        except (KeyError, TypeError, ValueError):
            return [Asked(source, "board", board, 0, [], error=f"{board}: no rows")]
        rest = range(here, total, here) if here else ()
        return [Asked(source, "board", board, 0, [], body=first), *(Asked(source, "board", board, k, [url(offset, here)], headers) for k, offset in enumerate(rest, 1))]

    def read(self, partition: Asked):
        body, error = partition.body, partition.error
        if partition.urls:
            try:
                body = ask(partition.urls, partition.headers, self.pause)
            except (FetchError, OSError, ValueError) as e:
                error = str(e)
        if body is not None or error is not None:
            yield partition.source, partition.kind, partition.part, partition.page, body, error


class Boards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Boards)


def load(spark: SparkSession, only: list[str] | None = None, addresses: str | None = None, secrets: dict[str, str] | None = None, **options) -> DataFrame:
    """Pages of the sources ``only`` (None: all); ``addresses``: TOML text, else the built-in ones."""
    register(spark)
    reader = spark.read.format("boards").options(**{k: str(v) for k, v in options.items()}).option("only", ",".join(only or []))
    for name, value in (secrets or {}).items():
        reader = reader.option(f"secret.{name}", value)
    return (reader.option("addresses", addresses) if addresses else reader).load()


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def documents(pages: DataFrame) -> DataFrame:
    """(source_id, value, error) of whole payloads, as they are cached: a plain body, parts by name, or boards of pages."""
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "value"))), lambda x: x["value"]), ",")
    parts = pages.groupBy("source_id", "kind", "part").agg(values.alias("value"), F.max("error").alias("error"))
    body = F.when(F.col("kind") == "board", F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value"))
    each = parts.withColumn("field", F.concat(quoted(F.col("part")), F.lit(":"), body))
    fields = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("field")), ","), F.lit("}"))
    whole = each.groupBy("source_id", "kind").agg(F.first("value").alias("plain"), fields.alias("fields"), F.max("error").alias("error"))
    value = F.when(F.col("kind") == "plain", F.col("plain")).when(F.col("kind") == "part", F.col("fields")).otherwise(F.concat(F.lit('{"configs":'), F.col("fields"), F.lit("}")))
    return whole.select("source_id", F.when(F.col("error").isNull(), value).alias("value"), "error")


def bring(spark: SparkSession, sources: list, folder: str, addresses: str | None = None, secrets: dict[str, str] | None = None, warn: Callable[[str], None] = print, **options) -> dict[str, str]:
    """Bring cached payloads up to date: fresh, fetched, skipped (no secret), stale (the cached one is all there is) or missing.

    All stale sources are fetched by one job; payloads come to the driver, which owns the cache, one by one.
    """
    known = tomllib.loads(addresses or built_in())
    states = {s.id: "fresh" for s in sources if s.fresh(folder)}
    rest = {s.id: s for s in sources if s.id not in states}
    states |= {k: "skipped" for k, s in rest.items() if s.secret and not (secrets or {}).get(s.secret)}
    asked = [k for k in rest if k in known and k not in states]
    if asked:
        for r in documents(load(spark, asked, addresses, secrets, **options)).toLocalIterator():
            if r.error is None:
                path = Path(folder, rest[r.source_id].file)
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_name(f"{path.name}.part")
                part.write_text(pretty(r.value) if path.suffix == ".json" else r.value)
                part.replace(path)
                states[r.source_id] = "fetched"
            else:
                warn(f"{r.source_id}: {r.error}")
    for k, s in rest.items():
        states.setdefault(k, "stale" if Path(folder, s.file).exists() else "missing")
    return states


def pretty(payload: str) -> str:
    """JSON as it is cached; what isn't JSON stays as it came, for the reader to complain about."""
    try:
        return json.dumps(json.loads(payload), indent=2, ensure_ascii=False) + "\n"
    except ValueError:
        return payload
