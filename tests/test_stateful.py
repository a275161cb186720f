"""State of models over streams: order of batches, late news, timers."""

import itertools

from pyspark.sql import functions as F

from plumbline.streaming import stateful

ROWS = [
    ("a", "reading", "x", 1, 1.0, None, 1),
    ("a", "reading", "x", 3, 3.0, None, 3),
    ("a", "reading", None, 2, 2.0, None, 2),
    ("a", "reading", "x", 4, None, None, 4),
    ("b", "incident", "i", 1, 50.0, True, 1),
    ("b", "incident", "i", 2, 50.0, False, 2),
    ("b", "incident", "j", 1, 70.0, True, 3),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, kind string, name string, ord long, value double, open boolean, day int").withColumn("ts", F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, day)"))


def test_any_order_of_batches(spark):
    """One row a batch, in two opposite orders of ``ord``: what is late changes nothing."""
    stateful.ready(spark)
    for turn in (False, True):
        rows = sorted(ROWS, key=lambda r: r[3], reverse=turn)
        got = {r.key: (r.suites, r.incident) for r in fed(spark, [[r] for r in rows]).collect()}
        assert got == {"a": ({"x": 3.0, "": 2.0}, None), "b": ({}, 70.0)}


def fed(spark, batches, keep=None):
    import tempfile
    import time

    folder = tempfile.mkdtemp()
    for k, rows in enumerate(batches):
        table(spark, rows).drop("day").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(stateful.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = itertools.count()
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/{next(seen)}")
    stateful.followed(stream, keep).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stateful.latest(spark.read.schema(stateful.OUTPUT).parquet(f"{folder}/out/*"))


def test_timers_close_incidents(spark):
    """An incident that nobody tells of for two days closes; one that is told of again doesn't."""
    stateful.ready(spark)
    rows = [[("b", "incident", "i", 1, 50.0, True, 1), ("c", "incident", "i", 1, 40.0, True, 1)], [("c", "incident", "i", 2, 45.0, True, 8)], [("d", "reading", "x", 1, 1.0, None, 9)]]
    got = {r.key: (r.incident, r.version) for r in fed(spark, rows, keep=2 * 86_400).collect()}
    assert got == {"b": (None, 2), "c": (45.0, 2 if got["c"][1] == 2 else 3), "d": (None, 1)}


def test_replay_and_empty_table(spark):
    got = {r.key: r.value for r in stateful.newest_of(stateful.replayed(table(spark, ROWS), 3), "x").collect()}
    assert got == {"a": 3.0, "b": None}
    assert stateful.replayed(table(spark, ROWS).limit(0), 2).count() == 0
