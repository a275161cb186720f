"""Mixing sources to target weights by a low-discrepancy schedule (operator 5).

Slots 0, 1, 2, ... get van der Corput points; the cumulated shares of the
sources map each point to a source, so every stretch of the schedule holds the
sources in their proportions. A slot's rank among its source's slots says which
block of that source it takes: documents of a source stand in a shuffled order,
and this stream of words, repeated as often as needed, is cut into blocks of
BLOCK words. The last block of a source ends at its target, so what is taken is
the target, rounded to words. Shares are counted in blocks, and there are a
power of two slots, under twice the blocks: so many points as a source has
blocks lie in its share then, however small it is. The points of 2^m slots are
the multiples of 2^-m, so each source lists its own, and a slot is the reversed
digits of its point.

Only DataFrame functions are used. The order within a source is that of
md5(seed:doc_id:md5(text)), so reruns agree. Ranks and stream positions are
prefix sums over pieces, as many as a piece has rows: totals of (source, piece)
first, then within a piece; no source is ever in one task. Null texts and texts
without words have size 0 and are never taken; very long texts are counted whole
and run through many blocks; a null source is a source of its own, last in
order; repeated rows are documents of their own, and ties, rows of one id and
text, may stand for each other; an empty table gives no rows. Columns besides
those named are never looked at, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, free, named, small

WORD = r"[^\x20\x09-\x0D]+"
#: Base weights of sources in the order of their code points, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words; no source more than this multiple of its own.
SHARE, MOST_TIMES = 1.5, 2.0
#: Words of a block.
BLOCK = 1024
#: Points that a task lists at a time, slots whose rows stand together in a mix.
LISTED, STRETCH = 10_000, 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, times: float = MOST_TIMES) -> DataFrame:
    """Targets of sources: (source, source_size) in, with weight, target and cumulated target out.

    Weighted shares of the total, where what exceeds a source's limit is shared
    again by weight. A level x with sum(min(weight * x, limit)) = total solves
    this; sources reach their limits in the order of limit / weight, so x
    follows from running sums, without iterating. One row for each source; a
    global window, as sources are few against documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(times)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        # it rises while sources reach their limits and falls after the first that doesn't
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("limit")))
        .withColumn("low", F.coalesce(F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("goal", F.round("target").cast("long"))
        .select("source", "source_size", "target", "low", "goal", F.sum("target").over(everything).alias("all"))
    )


def reversed_digits(number: Column, bits: int) -> Column:
    """The ``bits`` binary digits of a number in reverse: the slot of a point, and the point of a slot, as whole numbers."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def prefix(df: DataFrame, keys: list[str], piece: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Sums of ``value`` over the rows before, for each of ``keys``: totals of pieces first, then within each piece."""
    total = df.groupBy(*keys, piece).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select(*[F.col(k).alias(f"__{k}") for k in [*keys, piece]], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, piece]])
    within = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return ranked.join(starts, same).withColumn(name, F.col(name) + F.col("__before")).drop("__before", *[f"__{k}" for k in [*keys, piece]])


def pieces_of(rows: int) -> int:
    """As many pieces as each has rows."""
    return max(1, math.isqrt(rows))


def schedule(shares: DataFrame) -> DataFrame:
    """The slots (slot, at, rank) of the sources; ``shares``: (at, blocks), numbered in order."""
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    ends = cut(shares.filter("blocks > 0").select("at", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("low")))
    n = ends.agg(F.sum("blocks").alias("n")).first().n or 0
    bits = max(1, (n - 1).bit_length())
    cell = lambda x: f"cast((cast({x} as decimal(38, 0)) * {1 << bits} + {max(n, 1) - 1}) div {max(n, 1)} as bigint)"
    points = ends.selectExpr("at", "blocks", f"{cell('low')} as first", f"{cell('low + blocks')} as beyond")
    parts = points.withColumn("part", F.explode(F.sequence(F.expr(f"first div {LISTED}"), F.expr(f"(beyond - 1) div {LISTED}")))).repartition("at", "part")
    listed = parts.withColumn("point", F.explode(F.sequence(F.greatest("first", F.col("part") * LISTED), F.least("beyond", (F.col("part") + 1) * LISTED) - 1)))
    slots = cut(listed.select("at", "blocks", reversed_digits(F.col("point"), bits).alias("slot")).withColumn("piece", F.expr(f"slot div {-(-(1 << bits) // pieces_of(1 << bits))}")))
    return prefix(slots, ["at"], "piece", ["slot"], F.lit(1), "rank").filter("rank < blocks").select("slot", "at", "rank")


def key_of(text: Column, id_col: Column, seed: int) -> Column:
    """A document's place in the shuffled order of its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def stretches(df: DataFrame, text: str, source: str, id_col: str, weights: tuple, share: float, times: float, seed: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents, the sources, each source's stream of documents, and what each pass takes of a document: (at, start, turn, taken, slot)."""
    docs = cut(df.select(named(id_col).alias("doc_id"), named(source).cast("string").alias("source"), words(named(text)).alias("size"), key_of(named(text), named(id_col), seed).alias("order")))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_source = cut(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, times).withColumn("at", F.row_number().over(by_name)))
    pieces = pieces_of(docs.count())
    stream = docs.filter("size > 0").withColumn("piece", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * pieces).cast("long"))
    sourced = small(by_source.select(F.col("source").alias("name"), "at", "source_size", "goal"))
    stream = stream.join(sourced, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "order", "at", "piece", "size", "source_size", "goal")
    stream = cut(prefix(stream, ["at"], "piece", ["order", "size"], F.col("size"), "start"))
    # a document's stretches of the repeated stream, and the blocks that each meets
    passes = F.sequence(F.lit(0), F.floor((F.col("goal") - 1) / F.col("source_size")).cast("int"))
    spans = stream.filter("goal > 0").withColumn("turn", F.explode(passes)).withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
    spans = spans.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal"))).filter(F.col("from") < F.col("to"))
    met = spans.withColumn("rank", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    part = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    slots = schedule(by_source.select("at", F.ceil(F.col("goal") / block).alias("blocks")))
    taken = met.select("at", "start", "turn", "rank", part.alias("part")).join(slots, ["at", "rank"])
    return docs, by_source, stream, cut(taken.groupBy("at", "start", "turn").agg(F.sum("part").alias("taken"), F.min("slot").alias("slot")))


def mix(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, times: float = MOST_TIMES, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``df``: doc_id, size, source, source_size, target, taken, first_slot (null if nothing is taken)."""
    docs, by_source, stream, taken = stretches(df, text, source, id_col, weights, share, times, seed, block)
    sums = taken.groupBy("at", "start").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    full = stream.join(sums, ["at", "start"], "left").select("doc_id", "at", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    called = by_source.select("at", F.col("source").alias("name"), "source_size", "target")
    none = docs.filter("size = 0").join(small(called), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "at", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return full.unionByName(none).join(small(called), "at").select("doc_id", "size", F.col("name").alias("source"), "source_size", "target", "taken", "first_slot")


def mixed(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, times: float = MOST_TIMES, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` as the mix takes them, stretch by stretch of the schedule in the order of their slots.

    Only the document at which a source's target falls is taken in part, by its
    last pass; it is taken whole if its blocks have half of it or more, so what is
    taken of a source is within half a document of its target. A source whose
    target is under half of its first document gives that one document: none
    with a target is left out. Repeated rows of one id and text are taken or left
    together.
    """
    _, _, stream, taken = stretches(df, text, source, id_col, weights, share, times, seed, block)
    each = taken.join(stream.select("at", "start", "order", "size"), ["at", "start"]).groupBy("order", "turn").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("slot").alias("slot"), F.min("start").alias("start"))
    key, slot = free(df, "key"), free(df, "slot")
    kept = cut(each.filter("2 * taken >= size or start = 0 and turn = 0").select(F.col("order").alias(key), F.col("slot").alias(slot)))
    rows = df.withColumn(key, key_of(named(text), named(id_col), seed)).join(kept, key)
    return rows.repartition(F.expr(f"{slot} div {STRETCH}")).sortWithinPartitions(slot, key).select(*map(named, df.columns))
