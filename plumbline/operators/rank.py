"""Places, leaders and changes between runs. Every order is total, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import change
from plumbline.operators.cuts import cut


def dealt(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` in ranges of about as many rows, by the key and the whole order at once, and the number of each row's ``__range``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, F.col(key), *order).withColumn("__range", F.spark_partition_id()))


def placed(df: DataFrame, key: str, value: str, ties: list[str], down: bool = True) -> DataFrame:
    """Add place, from 1 on, and total, for each key.

    Rows are dealt in ranges of about as many rows, by key, value and ties at
    once, so neither a key nor a value that most rows share is in one task, if
    ties tell its rows apart. Ranges of a key are counted, and rows numbered
    within each behind those of the ranges before.
    """
    x = F.col(value)
    order = [x.desc() if down else x.asc(), *[F.col(t) for t in ties]]
    ranged = dealt(df, key, order)
    counts = ranged.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    by_key = Window.partitionBy("__key")
    before = F.sum("__n").over(by_key.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__key", "__of", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(by_key).alias("total"))
    within = Window.partitionBy("__range", key).orderBy(*order)
    numbered = ranged.withColumn("place", F.row_number().over(within).cast("long"))
    back = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
    return back.withColumn("place", F.col("place") + F.col("__start")).drop("__key", "__of", "__start", "__range")


def rank_for(long: DataFrame, key: str = "metric", value: str = "score", entity: str = "entity") -> DataFrame:
    """Add place (1 is best, ties by entity) and total, for each key."""
    return placed(long, key, value, [entity])


def unpivot(df: DataFrame, columns: list[str], key: str = "role", value: str = "score", entity: str = "entity") -> DataFrame:
    return df.unpivot([entity], columns, key, value)


def leaders(df: DataFrame, columns: list[str], k: int = 3, entity: str = "entity") -> DataFrame:
    """The best ``k`` of each column, with their places."""
    best = Window.partitionBy("role").orderBy(F.desc("score"), entity)  # Spark keeps the best k of each task before it shuffles
    return unpivot(df, columns, entity=entity).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def top(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    return df.orderBy(by.desc(), *ties).limit(k)


def deltas(now: DataFrame, before: DataFrame | None, columns: list[str], entity: str = "entity") -> DataFrame:
    """(entity, role, score, previous, change) of all columns; without an earlier run nothing has changed."""
    long = unpivot(now, columns, entity=entity)
    if before is None:
        return long.withColumn("previous", F.lit(None).cast("double")).withColumn("change", F.lit("none"))
    old = unpivot(before, columns, entity=entity).withColumnRenamed("score", "previous")
    return long.join(old, [entity, "role"], "left").withColumn("change", change(F.col("score"), F.col("previous")))


def filtered(df: DataFrame, text: Column, word: str = "", vendor: str = "") -> DataFrame:
    """Rows whose text holds ``word`` and whose vendor is ``vendor``; an empty one asks for nothing."""
    out = df.filter(F.lower(text).contains(word.lower())) if word else df
    return out.filter(F.col("vendor") == vendor) if vendor else out
