"""Which snapshot of a source is read."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import snapshots


def test_newest_of_each_source(spark, tmp_path):
    def put(source, name, text, at):
        path = tmp_path / f"source_id={source}" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (at, at))

    put("a", "1.txt", "old", 1_000)
    put("a", "2.txt", "new", 2_000)
    put("a", "3.txt", "future", 9_000)
    put("a", "_hidden", "no", 2_500)
    put("b", "x.txt", "stale", 100)
    put("d", "x.txt", "unasked", 2_900)
    sources = spark.createDataFrame([("a", 1_001), ("b", 10), ("c", 10)], "source_id string, ttl long")
    now = F.timestamp_seconds(F.lit(3_000))
    gated = snapshots.gate(snapshots.listed(spark, str(tmp_path)), sources, now)
    assert {r.source_id: (r.state, (r.path or "").rsplit("/", 1)[-1]) for r in gated.collect()} == {"a": ("fresh", "2.txt"), "b": ("stale", "x.txt"), "c": ("missing", "")}
    rows = snapshots.chosen(spark, gated, "text", wholetext=True)
    assert {(r.source_id, r.value) for r in rows.collect()} == {("a", "new"), ("b", "stale")}
    assert len(rows.inputFiles()) == 2
    older = snapshots.gate(snapshots.listed(spark, str(tmp_path)), sources.withColumn("ttl", F.lit(1_000)), now)
    assert {r.source_id: r.state for r in older.collect()} == {"a": "stale", "b": "stale", "c": "missing"}
    with pytest.raises(ValueError):
        snapshots.chosen(spark, gated.filter("source_id = 'c'"))
