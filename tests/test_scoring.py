"""Normalization, weighted means, penalties: single cases and properties."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import score
from plumbline.operators.aggregate import Band, missing_safe_avg
from plumbline.operators.normalize import as_score, normalize

CELLS = "entity string, metric string, raw double, is_synth boolean, is_override boolean"
DEFS = "metric string, higher_better boolean, log_scale boolean, transform string"


def scores(spark, values, better=True, log=False, transform="percentile", synth=(), override=()):
    cells = spark.createDataFrame([(str(i), "m", x, i in synth, i in override) for i, x in enumerate(values)], CELLS)
    defs = spark.createDataFrame([("m", better, log, transform)], DEFS)
    return {int(r.entity): r.score for r in normalize(cells, defs).collect()}


def test_linear_curve(spark):
    got = scores(spark, [float(x) for x in range(101)])
    assert (got[5], got[95], got[50], got[0], got[100]) == pytest.approx((0, 100, 50, 0, 100))
    low = scores(spark, [float(x) for x in range(101)], better=False)
    assert (low[5], low[95]) == pytest.approx((100, 0))


def test_odd_populations(spark):
    assert scores(spark, [7.0]) == {0: 50.0}
    assert scores(spark, [7.0, 7.0, 7.0]) == {0: 50.0, 1: 50.0, 2: 50.0}
    assert scores(spark, [None, float("nan"), float("inf")]) == {}
    assert set(scores(spark, [0.0, -1.0, 1.0, 10.0], log=True)) == {2, 3}


def test_tail_curve(spark):
    got = scores(spark, [float(x) for x in range(100)], transform="tail_penalty")
    assert got[2] < 5 and 65 <= got[20] <= 75 and 80 <= got[50] <= 90 and got[99] > 95
    low = scores(spark, [float(x) for x in range(100)], better=False, transform="tail_penalty")
    assert low[99] < 5 < 95 < low[0]
    few = scores(spark, [0.0, 5.0, 10.0], transform="tail_penalty")
    assert (few[0], few[2]) == pytest.approx((0, 100))


def test_fractions_and_points(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (85.0,), (150.0,), (-5.0,), (None,)], "x double")
    assert [r.s for r in df.select(as_score(F.col("x")).alias("s")).collect()] == [50, 100, 85, 100, 0, None]


def test_borrowed_and_hand_set_values(spark):
    direct = [float(x) for x in range(101)]
    got = scores(spark, [*direct, 100.0, 100.0, 1000.0], synth={101, 103}, override={102})
    assert (got[101], got[102], got[103]) == pytest.approx((92.5, 95, 92.5))
    assert got[95] == pytest.approx(100)  # the outlier moved nothing


def average(spark, values, weights, band=Band()):
    df = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])
    m = missing_safe_avg({k: F.col(k) for k in values}, weights, "G/", band)
    r = df.select(m.value.alias("v"), m.shrunk.alias("s"), m.missing.alias("m")).first()
    return r.v, r.s, r.m


@pytest.mark.parametrize(
    "values, weights, want, shrunk",
    [
        ({}, {"a": 1.0}, 50, True),
        ({"a": 80, "b": 60}, {"a": 0.5, "b": 0.5}, 70, False),
        ({"a": 100}, {"a": 0.5, "b": 0.5}, 75, True),
        ({"a": 80, "b": 100}, {"a": 0.4, "b": 0.4, "c": 0.2}, 90, False),
        ({"a": 60, "b": math.nan}, {"a": 0.5, "b": 0.5}, 55, True),
        ({"a": 60}, {}, 50, True),
    ],
)
def test_missing_safe_avg(spark, values, weights, want, shrunk):
    value, was, gone = average(spark, {k: float(v) for k, v in values.items()}, weights)
    assert value == pytest.approx(want) and was is shrunk
    assert gone == sorted(f"G/{k}" for k in weights if k not in values or math.isnan(values[k]))


def test_shrink_band_is_configured(spark):
    assert average(spark, {"a": 90.0}, {"a": 0.65, "b": 0.35}, Band(0.5, 0.1))[1] is False


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0.05, 1), st.floats(0, 100)), min_size=1, max_size=6), st.integers(0, 5), st.floats(0, 50))
def test_a_lower_input_never_raises_a_full_mean(spark, pairs, at, less):
    keys = [f"k{i}" for i in range(len(pairs))]
    weights = {k: w for k, (w, _) in zip(keys, pairs, strict=True)}
    values = {k: x for k, (_, x) in zip(keys, pairs, strict=True)}
    k = keys[at % len(keys)]
    first = average(spark, values, weights)[0]
    again = average(spark, dict(reversed(values.items())), dict(reversed(weights.items())))[0]
    lower = average(spark, values | {k: max(0.0, values[k] - less)}, weights)[0]
    assert first == again and lower <= first + 1e-9


def test_levels_and_penalty(spark):
    df = spark.createDataFrame([("e", 100.0, None)], "entity string, a double, b double")
    up = score.add_level(df, {"comp": {"a": 0.4, "b": 0.6}}, shrunk=True)
    assert up.first().comp == pytest.approx(70)
    roles = score.add_level(score.add_level(df.select("entity"), {"g": {"x": 1.0}}), {"r": {"g": 1.0}})
    assert roles.first().r == 50
    points = lambda health, synth=False, floor=20.0: spark.range(1).select(score.health_penalty(F.lit(health).cast("double"), F.lit(synth), 60.0, floor).alias("p")).first().p
    assert (points(80.0), points(None), points(10.0, True), points(10.0, floor=60.0)) == (0, 0, 0, 0)
    assert points(20.0) == points(0.0) == 6 and points(40.0) == pytest.approx(3)
