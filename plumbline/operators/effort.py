"""How much reasoning effort a row's text tells of, and whether the row may score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_name
from plumbline.functions.values import NOT_OF_NUMBERS, once

#: Classes in their order of preference (fixed values).
PREFERENCE = ("default", "medium", "thinking", "non_reasoning", "low", "high", "max", "other")
#: Which phrase decides first (fixed values).
DECIDES = [
    ("default", ("default",)),
    ("medium", ("medium",)),
    ("non_reasoning", ("non reasoning",)),
    ("low", ("low",)),
    ("thinking", ("thinking", "reasoning", "adaptive")),
    ("high", ("high",)),
    ("max", ("max", "xhigh")),
]
#: Classes that score (fixed values).
ALLOWED = ("default", "medium", "thinking")


def effort_class(normal: Column) -> Column:
    """The class of a normal text; without any marker it is the default."""

    def first_of(padded: Column) -> Column:
        out = F.lit("default")
        for name, phrases in reversed(DECIDES):
            out = F.when(reduce(Column.__or__, [padded.contains(f" {p} ") for p in phrases]), name).otherwise(out)
        return out

    return once(F.concat(F.lit(" "), normal, F.lit(" ")), first_of)


def effort_rank(effort: Column) -> Column:
    out = F.lit(len(PREFERENCE) - 1)
    for i, name in enumerate(PREFERENCE[:-1]):
        out = F.when(effort == name, i).otherwise(out)
    return out


def row_text(name: Column, fields: Column) -> Column:
    """A row's name and its texts (a map, numbers left out) in the order of their keys."""
    values = F.sort_array(F.map_entries(fields)).getField("value")
    words = F.filter(values, lambda v: v.isNotNull() & (v.rlike(NOT_OF_NUMBERS) | v.try_cast("double").isNull()) & ~v.isin("true", "false"))
    return F.concat_ws(" ", name, words)


def with_effort(rows: DataFrame) -> DataFrame:
    """Add ``effort``, the class of each row's name and texts.

    Each step is made once a row, by explode(): a filter on a plain column would
    repeat all that leads to it, in the conditions of joins too.
    """
    made = lambda df, step, name: df.select("*", F.explode(F.array(step)).alias(name))
    normal = made(rows, normalize_name(row_text(F.col("model_name"), F.col("fields"))), "__normal")
    return made(normal, effort_class(F.col("__normal")), "effort").drop("__normal")


def may_score(effort: Column, source_id: Column, entity: Column, vendor: Column, exceptions: list[dict] = ()) -> Column:
    """Allowed classes, and exceptions: dicts of source, efforts and entity or vendor."""
    ok = effort.isin(*ALLOWED)
    for e in exceptions:
        own = (source_id == e["source"]) & effort.isin(*e["efforts"])
        own = own & (entity == e["entity"]) if "entity" in e else own
        own = own & (vendor == e["vendor"]) if "vendor" in e else own
        ok = ok | F.coalesce(own, F.lit(False))
    return ok
