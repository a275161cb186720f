"""Numbers: coercion, clamps, small formulas. Missing is NULL; NaN and infinities count as missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Letters that no form of a number has, so that most texts are told from numbers without an attempt to read them.
NOT_OF_NUMBERS = "[ghj-moq-su-wzGHJ-MOQ-SU-WZ]"
#: Prompt and completion parts of a blended price (fixed values).
PROMPT_PART, COMPLETION_PART = 0.75, 0.25
#: Lower bounds of score tiers, and the least change that counts (fixed values).
HIGH, MIDDLE, LEAST_CHANGE = 70.0, 50.0, 0.05


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated a single time, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def finite(x: Column) -> Column:
    """``x``, NULL unless it is a finite number."""
    return F.when(F.abs(x) < INFINITY, x)


def number_like(x: Column, trim: bool = False) -> Column:
    """A number of a JSON value's text; forms that only Java reads, as '5d', aren't numbers."""
    x = F.trim(x) if trim else x
    return F.when(~x.rlike(r"[dDfF\s]$|^\s|" + NOT_OF_NUMBERS), x.try_cast("double"))


def json_number(x: Column) -> Column:
    """As number_like after trimming; true and false are 1 and 0."""
    return F.when(x == "true", F.lit(1.0)).when(x == "false", F.lit(0.0)).otherwise(number_like(x, trim=True))


def clamp(x: Column, low, high) -> Column:
    """NULL stays NULL, unlike in least() and greatest()."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def smoothstep(t: Column) -> Column:
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Half away from zero for x >= 0."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


def micro(x: Column) -> Column:
    """Six decimals, the precision of printed scores."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def first_number(*paths: Column) -> Column:
    """The first of several places that holds a number; others are passed over."""
    return F.coalesce(*map(number_like, paths))


def blended_cost(prompt: Column, completion: Column) -> Column:
    x = F.lit(PROMPT_PART) * prompt + F.lit(COMPLETION_PART) * completion
    return F.when((x > 0) & (x < INFINITY), x)


def mean_of_present(*xs: Column) -> Column:
    """The mean of those that aren't NULL; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return F.when(n > 0, total / n)


def positive(x: Column) -> Column:
    """Zero stands for "not measured"."""
    return F.when(x > 0, x)


def score_tier(x: Column) -> Column:
    return F.when(x >= HIGH, "high").when(x >= MIDDLE, "mid").otherwise("low")


def change(now: Column, before: Column) -> Column:
    """up, down or none; none too without an earlier score."""
    d = now - before
    return F.when(before.isNull() | (F.abs(d) < LEAST_CHANGE), "none").when(d > 0, "up").otherwise("down")


def rank_bar(place: Column, total: Column) -> Column:
    """Width in percent: the first has all of it."""
    return (total - place + 1) / total * 100.0


def mean_of(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs) / F.lit(float(len(xs)))


#: Of radar charts: room below the lowest score, least range, radius, scale without scores (fixed values).
ROOM, LEAST_RANGE, RADIUS, NO_SCALE = 10.0, 10.0, 50.0, (60.0, 100.0)


def radar_scale(low: Column, high: Column) -> tuple[Column, Column]:
    """Baseline and ceiling of a chart whose scores lie in low..high."""
    base = F.when(finite(low).isNotNull() & finite(high).isNotNull(), clamp(low - ROOM, 0.0, 90.0)).otherwise(NO_SCALE[0])
    top = F.when(finite(low).isNotNull() & finite(high).isNotNull(), F.least(F.greatest(high, base + LEAST_RANGE), F.lit(100.0))).otherwise(NO_SCALE[1])
    return base, top


def radar_radius(x: Column, base: Column, top: Column) -> Column:
    return (F.least(F.greatest(x, base), top) - base) / F.greatest(top - base, F.lit(LEAST_RANGE)) * RADIUS


#: Order of reasoning efforts where a source has several rows of a name (fixed values).
EFFORT_ORDER = [("", "?", "default", "medium", "adaptive", "thinking"), ("low",), ("high",), ("xhigh", "x-high"), ("max", "pro")]


def effort_priority(effort: Column) -> Column:
    """Lower goes first; NULL counts as unspecified."""
    low, out = F.lower(F.coalesce(effort, F.lit(""))), F.lit(len(EFFORT_ORDER))
    for i, names in reversed(list(enumerate(EFFORT_ORDER))):
        out = F.when(low.isin(*names), i).otherwise(out)
    return out


def is_fresh(written: Column, now: Column, ttl_seconds) -> Column:
    """A cached payload may be used while it is younger than its time to live; one from the future may not."""
    ttl = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)
    return (written <= now) & (F.unix_micros(now) - F.unix_micros(written) < ttl * F.lit(1_000_000).cast("long"))
