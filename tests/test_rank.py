"""Places and percentiles where most values are equal."""

import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import normalize, rank


def test_ties_are_spread_and_numbered(spark):
    r = random.Random(1)
    rows = [("m", 5.0 if r.random() < 0.9 else r.gauss(0, 9), f"e{k:05}") for k in range(20_000)] + [("n", 1.0, "x"), ("n", None, "y"), (None, 2.0, "z")]
    df = spark.createDataFrame(rows, "metric string, score double, entity string").repartition(7)
    sizes = [x["count"] for x in rank.dealt(df, "metric", [F.col("score").desc(), F.col("entity")]).groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)
    got = {(x.metric, x.entity): (x.place, x.total) for x in rank.rank_for(df).collect()}
    order = sorted((x for x in rows if x[0] == "m"), key=lambda x: (-x[1], x[2]))
    assert all(got["m", e] == (k, 20_000) for k, (_, _, e) in enumerate(order, 1))
    assert got["n", "x"] == (1, 2) and got["n", "y"] == (2, 2) and got[None, "z"] == (1, 1)


def percentile(v, q):
    at = q * (len(v) - 1)
    lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
    return lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi


def test_percentiles_are_exact(spark, monkeypatch):
    r = random.Random(1)
    values = {
        "one": [3.0],
        "two": [2.0, 1.0],
        "ties": [r.choice([5.0] * 9 + [r.gauss(0, 1)]) for _ in range(4_000)],
        "wide": [r.gauss(0, 1) ** 9 for _ in range(3_000)],
        "few": [r.choice([1.0, 2.0]) for _ in range(50)],
    }
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("none", None), ("two", None)], "metric string, x double").repartition(5)
    points = (0.0, 0.02, 0.05, 0.5, 0.95, 0.98, 1.0)
    for width in (normalize.SLACK, -0.3):  # brackets that miss every place cost time, not rows
        monkeypatch.setattr(normalize, "SLACK", width)
        got = {x.metric: x for x in normalize.order_statistics(df, "metric", "x", points).collect()}
        assert set(got) == set(values)
        for k, v in values.items():
            assert list(got[k].p) == [percentile(sorted(v), q) for q in points]
            assert (got[k].least, got[k].most, got[k].n) == (min(v), max(v), len(v))
