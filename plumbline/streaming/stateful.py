"""Readings and incidents of models as a stream with state: newest values by suite, open incidents, health.

Input rows are (key, kind, name, ord, value, open, ts). A ``reading`` is a value
of the suite ``name`` (NULL: of no suite); an ``incident`` is news of the
incident ``name``, with the health it leaves the model, and whether it is open.
``ord`` orders the readings of a suite and the news of an incident: what comes
late changes nothing that is newer, so batches may come in any order. The state
holds one value for each suite and one row for each incident, not the stream.

Incidents may close by themselves: with ``keep`` seconds set, one that nobody has
told of for so long, by the time of the events, is closed by a timer. What is
known of a closed incident is kept as long, so that late news don't open it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.cuts import cut, remove, shared_folder

INPUT = "key string, kind string, name string, ord long, value double, open boolean, ts timestamp"
OUTPUT = "key string, version long, suites map<string,double>, incident double"
STATE = "version long, readings array<struct<suite:string,ord:long,value:double>>, incidents array<struct<id:string,ord:long,health:double,open:boolean,until:long>>"
#: The name of readings of no suite in the state.
NONE = ""


class Models(StatefulProcessor):
    """State of one model: readings by suite, incidents by id.

    All of it is one value, read and written once a batch: each access from Python is a round trip.
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[tuple[str, str], tuple] = {}
        for _, kind, name, at, value, is_open, ts in rows:  # the newest of the batch first
            own = (kind, name or NONE)
            if (kind == "incident" or value is not None) and (own not in newest or newest[own][0] < at):
                newest[own] = (at, value, bool(is_open), ts)
        version, readings, incidents = self.known()
        changed = False
        for (kind, name), (at, value, is_open, ts) in newest.items():
            held = readings if kind == "reading" else incidents
            if name in held and held[name][0] >= at:
                continue
            changed = True
            if kind == "reading":
                held[name] = (at, value)
            else:
                until = int(ts.timestamp() * 1000) + 1000 * self.keep if self.keep and ts else 0
                held[name] = (at, value, is_open, until)
                if until:
                    self.handle.registerTimer(until)
        if changed:
            self.hold(version + 1, readings, incidents)
            yield told(key, version + 1, readings, incidents)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, (version, readings, incidents) = expiredTimerInfo.getExpiryTimeInMs(), self.known()
        left = {name: x for name, x in incidents.items() if not x[3] or x[3] > now}
        was_open = any(x[2] for name, x in incidents.items() if name not in left)
        if len(left) < len(incidents):
            self.hold(version + was_open, readings, left)
        if was_open:
            yield told(key, version + 1, readings, left)

    def known(self) -> tuple[int, dict, dict]:
        version, readings, incidents = self.model.get() or (0, [], [])
        return version, {name: tuple(x) for name, *x in readings}, {name: tuple(x) for name, *x in incidents}

    def hold(self, version: int, readings: dict, incidents: dict) -> None:
        self.model.update((version, [(name, *x) for name, x in readings.items()], [(name, *x) for name, x in incidents.items()]))


def told(key, version: int, readings: dict, incidents: dict) -> Row:
    worst = [health for _, health, is_open, _ in incidents.values() if is_open and health is not None]
    return Row(key=key[0], version=version, suites={suite: value for suite, (_, value) in readings.items()}, incident=min(worst, default=None))


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def followed(rows: DataFrame, keep: int | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, version, suites, incident) of each model that a batch has changed; ``version`` counts up. Needs the RocksDB state store."""
    mode = "EventTime" if keep else "None"
    x = rows.select(*names_of(INPUT))
    x = x.withWatermark("ts", delay) if keep else x
    return x.groupBy("key").transformWithState(statefulProcessor=Models(keep), outputStructType=OUTPUT, outputMode="Update", timeMode=mode)


def newest_of(state: DataFrame, suite: str) -> DataFrame:
    """Add ``value``: the newest of ``suite``, else of no suite."""
    return state.withColumn("value", F.coalesce(F.col("suites")[suite], F.col("suites")[NONE]))


def ready(spark: SparkSession) -> None:
    """State of this kind lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(updates: DataFrame) -> DataFrame:
    """Of all updates of a model the last one."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return updates.withColumn("place", place).filter("place = 1").drop("place")


def replayed(rows: DataFrame, batches: int, keep: int | None = None) -> DataFrame:
    """latest() state after a table has gone through the stream in about ``batches`` batches, dealt by a hash, whatever their order."""
    spark = rows.sparkSession
    ready(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.select(*names_of(INPUT)).repartition(batches, F.xxhash64("key", "name", "ord")).write.parquet(f"{folder}/in")
    files = max(1, len(spark.read.parquet(f"{folder}/in").inputFiles()) // batches)
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")
    query = followed(stream, keep).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = cut(latest(spark.read.schema(OUTPUT).parquet(f"{folder}/out/*")))
    remove(spark, folder)
    return out
