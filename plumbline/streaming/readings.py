"""Streams of readings: newest values kept up to date, and whole recomputation for what needs the population."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.history import newest


def newest_by_suite(readings: DataFrame, suites: list[str], keys: list[str], watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """The newest value of each suite for each key, else the newest of no suite; works on streams and tables alike.

    ``readings``: keys, suite, value and a time. max_by keeps one value for each
    suite in the state, so the state grows with the keys and not with the stream.
    """
    x = readings.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark and x.isStreaming:
        x = x.withWatermark(ts, watermark)
    return x.groupBy(*keys).agg(*[newest(s, F.col("value"), F.col("suite"), F.col(ts)).alias(s) for s in suites])


def recomputed(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], table: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Append each batch of a stream of rows to ``table``, and write ``compute`` of all of it to ``out``.

    Normalization is relative to the whole population, so a new row may move
    every score: each batch recomputes. A batch that is replayed after a failure
    replaces its own part of the table.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        compute(spark.read.parquet(table).drop("batch")).write.mode("overwrite").parquet(out)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
