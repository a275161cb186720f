"""Readings over time: the newest of a suite, open incidents, worst and best of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import clamp


def newest(suite: str, value: Column, name: Column, order: Column) -> Column:
    """An aggregate: the last value of ``suite``, else the last one of no suite; other suites never count."""
    own = F.max_by(value, F.when((name == suite) & value.isNotNull(), order))
    legacy = F.max_by(value, F.when(name.isNull() & value.isNotNull(), order))
    return F.coalesce(own, legacy)


def open_incident(resolved_at: Column, method: Column, wanted: str = "canary_drift") -> Column:
    """Not resolved (absent, NULL or empty) and found by the wanted method."""
    return (F.coalesce(resolved_at, F.lit("")) == "") & F.coalesce(method == wanted, F.lit(False))


def incident_health(drop_percent: Column) -> Column:
    return clamp(F.lit(100.0) - drop_percent, 0.0, 100.0)


def worst(a: Column, b: Column) -> Column:
    """The lower of two; one alone if the other is NULL."""
    return F.least(a, b)


def two_key_join(left: DataFrame, right: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Add ``value`` of the row of ``right`` whose key is ``first``, else of that whose key is ``second``."""
    one = right.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"), F.lit(True).alias("__hit"))
    two = right.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    both = left.join(one, F.col(first) == F.col("__k1"), "left").join(two, F.col(second) == F.col("__k2"), "left")
    return both.withColumn(value, F.when(F.col("__hit"), F.col("__v1")).otherwise(F.col("__v2"))).drop("__k1", "__k2", "__v1", "__v2", "__hit")
