"""Many snapshots of many sources in one folder: which of each is read, decided in the plan.

Snapshots stand below ``source_id=<name>/``, each a file. What is listed is names
and times of modification; no file is opened before it is chosen. Of a source the
newest snapshot counts, ones from the future aside: ``fresh`` while it is younger
than the source's time to live, ``stale`` after that, when it is all there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import is_fresh


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, path, modified) of all snapshots: contents aren't read, as nobody asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = F.regexp_extract("path", r"/source_id=([^/]+)/", 1)
    hidden = F.regexp_extract("path", "([^/]*)$", 1).rlike("^[._]")
    return files.select(own.alias("source_id"), "path", F.col("modificationTime").alias("modified")).filter((F.col("source_id") != "") & ~hidden)


def gate(snapshots: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """(source_id, path, modified, state) of each of ``sources`` (source_id, ttl: seconds): fresh, stale or missing.

    A snapshot of equal age with the greater path wins.
    """
    newest = snapshots.filter(F.col("modified") <= now).groupBy("source_id").agg(F.max(F.struct("modified", "path")).alias("s"))
    state = F.when(F.col("s").isNull(), "missing").when(is_fresh(F.col("s.modified"), now, F.col("ttl")), "fresh").otherwise("stale")
    return sources.join(newest, "source_id", "left").select("source_id", F.col("s.path").alias("path"), F.col("s.modified").alias("modified"), state.alias("state"))


def chosen(spark: SparkSession, gated: DataFrame, format: str = "text", **options) -> DataFrame:
    """The rows of the chosen snapshots alone, with their ``source_id``; one path for each source comes to the driver."""
    paths = [r.path for r in gated.filter("path is not null").select("path").collect()]
    if not paths:
        raise ValueError("no source has a snapshot")
    rows = spark.read.format(format).options(**options).load(paths)
    return rows.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_path"), r"/source_id=([^/]+)/", 1))


def dated(spark: SparkSession, folder: str, milliseconds: dict[str, int]) -> None:
    """Set when the files below subfolders of ``folder`` were modified, as copies from another store need it."""
    jvm = spark._jvm
    for name, at in milliseconds.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for file in fs.listStatus(path):
            fs.setTimes(file.getPath(), at, -1)
