"""Raw values of many metrics to scores of 0 to 100, relative to each metric's population.

Cells are long: one row for each (entity, metric), with ``raw``, ``is_synth``
and ``is_override``. Exact percentiles are selected from counts of values; they
return to the cells by a join on the metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import clamp, finite
from plumbline.operators.cuts import cut, small

# The curves.
TINY = 1e-12
#: Percentiles that bound the linear curve, and the tail curve of large populations.
LINEAR, TAIL = (0.05, 0.95), (0.02, 0.98)
#: Below so many values the tail curve is bounded by the least and the largest.
SMALL = 20
#: Where the tail curve bends, and its score there.
BEND, BEND_SCORE = 0.20, 70.0
#: So many direct values make a population; else synthesized and overriding ones count too.
LEAST_DIRECT = 2
# End of the fixed values.
NEUTRAL = 50.0
#: Accuracy of the percentiles that bracket exact ones, and the half width of a bracket.
ACCURACY, SLACK = 2_000, 0.002


def between(x: Column, low: Column, high: Column) -> Column:
    """The place of ``x`` on low..high, cut to 0..1; NULL where these coincide."""
    span = high - low
    return F.when(F.abs(span) >= TINY, clamp((x - low) / F.when(F.abs(span) >= TINY, span), 0.0, 1.0))


def oriented(place: Column, higher_better: Column) -> Column:
    return F.when(higher_better, place).otherwise(F.lit(1.0) - place)


def linear_curve(x: Column, p5: Column, p95: Column, higher_better: Column) -> Column:
    place = oriented(between(x, p5, p95), higher_better)
    return F.when(x.isNotNull() & p5.isNotNull(), F.coalesce(place * 100.0, F.lit(NEUTRAL)))


def tail_curve(x: Column, low: Column, high: Column, higher_better: Column) -> Column:
    place = oriented(between(x, low, high), higher_better)
    bent = F.when(place >= BEND, F.lit(BEND_SCORE) + (place - F.lit(BEND)) / F.lit(1 - BEND) * F.lit(100.0 - BEND_SCORE)).otherwise(place / F.lit(BEND) * F.lit(BEND_SCORE))
    return F.when(x.isNotNull() & low.isNotNull(), F.coalesce(bent, F.lit(NEUTRAL)))


def as_score(x: Column) -> Column:
    """Fractions of 0 to 1 become percents; all is cut to 0..100. A true score of up to 1 is read as a fraction."""
    x = finite(x)
    return clamp(F.when((x >= -TINY) & (x <= 1.0 + TINY), x * 100.0).otherwise(x), 0.0, 100.0)


def mapped(x: Column, log_scale: Column) -> Column:
    """The value on the metric's scale: its logarithm, which only positive values have, or itself."""
    x = finite(x)
    return F.when(log_scale & (x > 0), F.ln(F.when(x > 0, x))).when(~log_scale, x)


def picked(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(k, i, x_low, x_high): the values at two places of the values (k, x) of a key, NULL where these aren't within lo..hi.

    ``bounds``: (k, i, low, high, lo, hi), places from 0 on. Of values outside only the number is kept.
    """
    side = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), 1).otherwise(0)
    met = rows.join(small(bounds), "k").select("k", "i", "low", "high", side.alias("side"), F.when(side == 0, F.col("x")).alias("x"))
    counted = met.groupBy("k", "i", "low", "high", "side", "x").agg(F.count("*").alias("times"))
    run = F.sum("times").over(Window.partitionBy("k", "i").orderBy("side", "x").rowsBetween(Window.unboundedPreceding, 0))
    # the first value whose running count passes a place stands at it
    passed = lambda at: F.min_by("x", F.when(F.col("run") > F.col(at), F.col("run")))
    return counted.withColumn("run", run).groupBy("k", "i").agg(passed("low").alias("x_low"), passed("high").alias("x_high"))


def order_statistics(values: DataFrame, key: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """(key, p, least, most, n): exact percentiles of the values of each key, between neighbours in proportion.

    No values are sorted or shuffled as rows. Approximate percentiles give each
    wanted place a bracket of values; values below it are counted, those within
    it are counted each. So many equal values are one row, and a place is read
    off the counts of a small part of the values. A place that its bracket misses
    is looked for in all values of its key, so percentiles are exact whatever the
    approximation is worth.
    """
    rows = values.select(F.col(key).alias("k"), F.col(value).alias("x")).filter("x is not null")
    around = sorted({min(max(q + d * SLACK, 0.0), 1.0) for q in points for d in (-1, 1)})
    first = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", around, ACCURACY).alias("a"))
    place = lambda q, up: (F.ceil if up else F.floor)(F.lit(q) * (F.col("n") - 1)).cast("long")
    edge = lambda q, d: F.col("a")[around.index(min(max(q + d * SLACK, 0.0), 1.0))]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), place(q, False).alias("low"), place(q, True).alias("high"), edge(q, -1).alias("lo"), edge(q, 1).alias("hi")) for i, q in enumerate(points)])
    bounds = cut(first.select("k", "n", "least", "most", F.explode(wanted).alias("w")).select("k", "n", "least", "most", "w.*"))
    found = cut(picked(rows, bounds))
    missed = found.filter("x_low is null or x_high is null").select("k", "i")
    if not missed.isEmpty():
        every = bounds.join(missed, ["k", "i"]).withColumn("lo", F.col("least")).withColumn("hi", F.col("most"))
        found = found.filter("x_low is not null and x_high is not null").unionByName(picked(rows, every))

    def point(q: Column) -> Column:
        at, lo, hi = q * (F.col("n") - 1), F.col("x_low"), F.col("x_high")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    each = bounds.join(found, ["k", "i"]).withColumn("q", F.element_at(F.array(*map(F.lit, points)), F.col("i") + 1))
    together = each.groupBy("k", "n", "least", "most").agg(F.array_sort(F.collect_list(F.struct("i", point(F.col("q")).alias("p")))).alias("p"))
    return together.select(F.col("k").alias(key), F.col("p.p").alias("p"), "least", "most", "n")


def population(cells: DataFrame, defs: DataFrame) -> DataFrame:
    """(metric, p2, p5, p95, p98, least, most, n): one row for each metric.

    Direct cells are the population where there are LEAST_DIRECT of them; that
    is settled before values without a logarithm are left out.
    """
    direct = ~F.col("is_synth") & ~F.col("is_override")
    x = cut(cells.join(F.broadcast(defs), "metric").select("metric", mapped(F.col("raw"), F.col("log_scale")).alias("x"), direct.alias("direct"), finite(F.col("raw")).isNotNull().alias("known")))
    counts = x.groupBy("metric").agg((F.count_if(F.col("direct") & F.col("known")) >= LEAST_DIRECT).alias("only_direct"))
    own = x.join(counts, "metric").filter((F.col("direct") | ~F.col("only_direct")) & F.col("x").isNotNull()).select("metric", "x")
    p = F.col("p")
    stats = order_statistics(own, "metric", "x", (TAIL[0], LINEAR[0], LINEAR[1], TAIL[1]))
    every = counts.select("metric").join(stats, "metric", "left")
    return every.select("metric", p[0].alias("p2"), p[1].alias("p5"), p[2].alias("p95"), p[3].alias("p98"), "least", "most", F.coalesce("n", F.lit(0)).alias("n"))


def normalize(cells: DataFrame, defs: DataFrame, synthesis: float = 0.15, override: float = 0.10) -> DataFrame:
    """Add ``score`` to the cells whose metric has a definition; cells without a score go.

    ``defs``: (metric, higher_better, log_scale, transform), transform one of
    percentile, tail_penalty, as_score. It is configuration, and broadcast.
    """
    stats = population(cells, defs)
    x = cells.join(F.broadcast(defs), "metric").join(stats, "metric")
    value, better = mapped(F.col("raw"), F.col("log_scale")), F.col("higher_better")
    few = F.col("n") < SMALL
    low, high = F.when(few, F.col("least")).otherwise(F.col("p2")), F.when(few, F.col("most")).otherwise(F.col("p98"))
    score = (
        F.when(F.col("transform") == "as_score", as_score(F.col("raw")))
        .when(F.col("transform") == "tail_penalty", tail_curve(value, low, high, better))
        .otherwise(linear_curve(value, F.col("p5"), F.col("p95"), better))
    )
    done = x.withColumn("score", softened(score, F.col("is_synth"), F.col("is_override"), synthesis, override))
    return done.filter(F.col("score").isNotNull()).select(*cells.columns, "score")


def softened(score: Column, is_synth: Column, is_override: Column, synthesis: float = 0.15, override: float = 0.10) -> Column:
    """Borrowed and hand-set values are pulled to the middle, in this order."""
    pull = lambda v, part: v * F.lit(1.0 - part) + F.lit(NEUTRAL * part)
    once = F.when(is_synth, pull(score, synthesis)).otherwise(score)
    return F.when(is_override, pull(once, override)).otherwise(once)
