"""Lineage cuts: what later steps read more than once is written once, to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a folder of our own stands in for it.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder
    if conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Beyond so many rows a side isn't broadcast.
MOST_BROADCAST = 50_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it is counted to be small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a frame to the shared folder and reads it again; at the end all of these go.

    For loops that join: unlike after cut(), Spark knows the size of what it reads, and doesn't multiply
    its guesses from round to round until the numbers themselves fill the driver.
    """
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    names = (f"{folder}/{k}" for k in count())

    def written(df: DataFrame) -> DataFrame:
        name = next(names)
        df.write.parquet(name)
        return spark.read.parquet(name)

    try:
        yield written
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
