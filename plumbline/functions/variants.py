"""Values of JSON of any shape, as VARIANT: by path, with absent ones and nulls kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import number_like


def parsed(text: Column) -> Column:
    """A VARIANT of JSON; NULL of what isn't JSON."""
    return F.try_parse_json(text)


def path(*names: str) -> str:
    """The path of nested keys of any characters, but both kinds of quotes in one."""
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def at(v: Column, *names: str) -> Column:
    """What stands under nested keys: NULL if nothing does, a VARIANT that holds null if that is what stands there."""
    return F.try_variant_get(v, path(*names), "variant")


def text_at(v: Column, *names: str) -> Column:
    """A string as it is, anything else as its JSON text; NULL only for what is absent."""
    x = at(v, *names)
    return F.when(F.is_variant_null(x), "null").otherwise(F.coalesce(F.try_variant_get(v, path(*names), "string"), F.to_json(x)))


def number_at(v: Column, *places: tuple[str, ...]) -> Column:
    """The first of several places that holds a number, or its text; places that hold something else are passed over."""
    return F.coalesce(*[number_like(F.try_variant_get(v, path(*names), "string")) for names in places])


def first_present(v: Column, *keys: str) -> Column:
    """The VARIANT under the first of several keys that is there; a null that is there counts."""
    return F.coalesce(*[at(v, k) for k in keys])


def items(df: DataFrame, *names: str) -> DataFrame:
    """(pos, item): elements of an array in JSON payloads ``value``, each a VARIANT."""
    return df.select(F.posexplode(F.try_variant_get(parsed(F.col("value")), path(*names), "array<variant>")).alias("pos", "item"))
