"""The shape that all readers give, and how payloads are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "source_id string, seq long, model_name string, vendor_hint string, fields map<string,string>, synthesized_from string"


class PayloadError(ValueError):
    """A payload without what a reader can't do without."""


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts; ``path`` may be a folder or a pattern of many snapshots."""
    return spark.read.text(path, wholetext=True)


def items(df: DataFrame, schema: str, *path: str) -> DataFrame:
    """(pos, item): elements of an array in JSON payloads; ``schema`` is that of the whole payload."""
    array = F.from_json("value", schema)
    for p in path:
        array = array[p]
    return df.select(F.posexplode(array).alias("pos", "item"))


def to_rows(df: DataFrame, source_id: str, name: Column, hint: Column | None, fields: dict[str, Column], *order) -> DataFrame:
    """Rows in ``order``; NULL fields are left out."""
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    out = df.select(name.alias("model_name"), (hint if hint is not None else F.lit(None).cast("string")).alias("vendor_hint"), kept.alias("fields"), F.struct(*order).alias("__order"))
    seq = F.row_number().over(Window.partitionBy(F.lit(source_id)).orderBy("__order")) - 1
    return out.select(F.lit(source_id).alias("source_id"), seq.cast("long").alias("seq"), "model_name", "vendor_hint", "fields", F.lit(None).cast("string").alias("synthesized_from"))


def some(df: DataFrame, source_id: str) -> DataFrame:
    """``df``, which must have rows."""
    if df.isEmpty():
        raise PayloadError(f"{source_id}: no rows")
    return df


def low_hint(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def named(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""
