"""Names, curves and weighted means as SQL functions, for users who write no Python after ``register(spark)``.

    SELECT normal_name(title), tail_score(x, low, high, true), known_mean(array(a, b), array(0.5D, 0.5D)) FROM t

Bodies are SQL, so Spark sees through them; the fixed values are those of the
DataFrame functions of the same things.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.functions import values as v
from plumbline.functions.text import COLON_VENDORS, ENTITIES, ORGANISATIONS, REFERENCE, SUFFIXES
from plumbline.operators import normalize as n
from plumbline.operators.aggregate import NEUTRAL, TINY, Band


def text(x: str) -> str:
    """A SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {text(old)}, {text(new)})"
    return x


def unescaped(s: str) -> str:
    """As functions.text.html_unescape()."""
    group = lambda k: f"regexp_extract(p, {text(REFERENCE)}, {k})"
    names = " ".join(f"WHEN {text(name)} THEN {text(char)}" for name, char in (("amp", "&"), *ENTITIES))
    code = f"CASE WHEN {group(2)} <> '' AND length({group(2)}) < 8 THEN cast({group(2)} AS BIGINT) WHEN {group(3)} <> '' AND length({group(3)}) < 7 THEN cast(conv({group(3)}, 16, 10) AS BIGINT) END"
    char = f"transform(array({code}), c -> CASE WHEN c BETWEEN 0 AND 1114111 AND NOT c BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END)[0]"
    part = f"coalesce(concat(coalesce(CASE {group(1)} {names} END, {char}), substring(p, locate(';', p) + 1)), concat('&', p))"
    return f"CASE WHEN contains({s}, '&') THEN array_join(transform(split({s}, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {part} END), '') ELSE {s} END"


def functions(band: Band = Band()) -> list[str]:
    """The statements that make the functions."""
    normal = replaced(f"trim(lower({unescaped('s')}))", [(f"{x}:", f"{x} ") for x in COLON_VENDORS])
    normal = f"regexp_replace({normal}, {text('(?<![0-9])[.]|[.](?![0-9])')}, ' ')"
    normal = replaced(f"trim(regexp_replace({normal}, {text('[^a-z0-9.]+')}, ' '))", ORGANISATIONS)
    endings = "|".join(sorted(SUFFIXES, key=len, reverse=True))
    place = lambda low, high: f"transform(array(struct({high} - {low} AS span)), r -> CASE WHEN abs(r.span) >= {n.TINY}D THEN least(greatest((x - {low}) / r.span, 0D), 1D) END)[0]"
    oriented = lambda low, high: f"CASE WHEN higher_better THEN {place(low, high)} ELSE 1D - {place(low, high)} END"
    bent = f"CASE WHEN q >= {n.BEND}D THEN {n.BEND_SCORE}D + (q - {n.BEND}D) / {1 - n.BEND}D * {100 - n.BEND_SCORE}D ELSE q / {n.BEND}D * {n.BEND_SCORE}D END"
    number = "abs(x) < double('infinity')"
    start = band.threshold - band.width / 2
    mean = f"""
        transform(transform(array(struct(
            aggregate(zip_with(scores, weights, (x, w) -> if({number}, w, 0D)), 0D, (a, b) -> a + b) AS weight,
            aggregate(zip_with(scores, weights, (x, w) -> if({number}, w * x, 0D)), 0D, (a, b) -> a + b) AS summed,
            aggregate(weights, 0D, (a, b) -> a + b) AS whole)),
            p -> struct(p.weight AS weight, p.whole AS whole, p.summed / if(abs(p.weight) < {TINY}D, 1D, p.weight) AS mean, p.weight / if(abs(p.whole) < {TINY}D, 1D, p.whole) AS c,
                        least(greatest((p.weight / if(abs(p.whole) < {TINY}D, 1D, p.whole) - {start}D) / {band.width}D, 0D), 1D) AS t)),
            p -> CASE WHEN abs(p.weight) < {TINY}D OR abs(p.whole) < {TINY}D THEN {NEUTRAL}D
                 ELSE least(greatest((p.mean * p.c + {NEUTRAL}D * (1D - p.c)) * (1D - p.t * p.t * (3D - 2D * p.t)) + p.mean * (p.t * p.t * (3D - 2D * p.t)), 0D), 100D) END)[0]"""
    made = {
        "normal_name(s STRING) RETURNS STRING": normal,
        "compact_name(s STRING) RETURNS STRING": f"regexp_replace(normal_name(s), {text('[^a-z0-9]')}, '')",
        "without_ending(s STRING) RETURNS STRING": f"CASE WHEN s NOT IN ({', '.join(map(text, SUFFIXES))}) THEN nullif(regexp_extract(s, {text(f'^(.+?) (?:{endings})$')}, 1), '') END",
        "linear_score(x DOUBLE, low DOUBLE, high DOUBLE, higher_better BOOLEAN) RETURNS DOUBLE": f"CASE WHEN x IS NOT NULL AND low IS NOT NULL THEN coalesce(({oriented('low', 'high')}) * 100D, {n.NEUTRAL}D) END",
        "tail_score(x DOUBLE, low DOUBLE, high DOUBLE, higher_better BOOLEAN) RETURNS DOUBLE": f"CASE WHEN x IS NOT NULL AND low IS NOT NULL THEN coalesce(transform(array({oriented('low', 'high')}), q -> {bent})[0], {n.NEUTRAL}D) END",
        "fraction_score(x DOUBLE) RETURNS DOUBLE": f"CASE WHEN {number} THEN least(greatest(if(x >= -{n.TINY}D AND x <= 1D + {n.TINY}D, x * 100D, x), 0D), 100D) END",
        "score_tier(x DOUBLE) RETURNS STRING": f"CASE WHEN x >= {v.HIGH} THEN 'high' WHEN x >= {v.MIDDLE} THEN 'mid' ELSE 'low' END",
        "known_mean(scores ARRAY<DOUBLE>, weights ARRAY<DOUBLE>) RETURNS DOUBLE": mean,
        "six_decimals(x DOUBLE) RETURNS DOUBLE": "floor(x * 1e6D + 0.5D) / 1e6D",
    }
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in made.items()]


def register(spark: SparkSession, band: Band = Band()) -> None:
    for statement in functions(band):
        spark.sql(statement)
