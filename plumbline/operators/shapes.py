"""What several sources do with their records: look up, merge and average them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the mean of what each key has; keys without a value have none."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(key).agg((F.sum(value).cast("double") / F.count("*")).alias(value))


def shown_as(df: DataFrame, key: str, names: DataFrame, name: str = "display") -> DataFrame:
    """Add ``name`` from a dictionary (key, name): that of the key, or the key itself."""
    own = names.select(F.col(key).alias("__key"), F.col(name))
    return df.join(own, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce(name, F.col(key).cast("string"))).drop("__key")


def first_of(df: DataFrame, name: Column, wanted: tuple[str, ...], order: str) -> DataFrame:
    """The first row with one of several names."""
    return df.filter(name.isin(*wanted)).orderBy(order).limit(1)


def under(entries: Column, *parts: Column) -> Column:
    """The entry of a map under a key that is made of parts."""
    return F.try_element_at(entries, F.concat_ws(":", *[p.cast("string") for p in parts]))


def has_any(values: Column, *wanted: str) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def last(value: Column, when: Column, order: Column) -> Column:
    """An aggregate: the last value there is where ``when`` holds."""
    return F.max_by(value, F.when(when & value.isNotNull(), order))


def first(value: Column, when: Column, order: Column) -> Column:
    return F.min_by(value, F.when(when, order))


def largest(value: Column, when: Column) -> Column:
    return F.max(F.when(when, value))
