import math

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, queries

DATA = "/root/testdata"


def filled(sizes, weights=(5, 2, 1), share=1.5, times=2.0):
    """Targets by sharing the excess again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, full = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set()
    while True:
        rest = total - sum(times * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        for s in order:
            target[s] = times * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > times * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, None: 500, "d": 7}, {"x": 3}, {"B": 0, "a": 9, None: 4}])
def test_targets_against_sharing_again(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_points_are_van_der_corputs(spark):
    got = [r.p for r in spark.range(9).select(mixing.reversed_digits(F.col("id"), 4).alias("p")).collect()]
    assert [p / 16 for p in got] == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625]


def test_schedule_is_even_at_every_point(spark):
    blocks = [600, 300, 99, 1]
    rows = mixing.schedule(spark.createDataFrame(list(enumerate(blocks, 1)), "at int, blocks long")).orderBy("slot").collect()
    seen = [0] * 4
    for i, r in enumerate(rows[:900]):
        assert r.rank == seen[r.at - 1]
        seen[r.at - 1] += 1
        assert all(abs(seen[k] - (i + 1) * n / 1000) < 2 + math.log2(i + 2) for k, n in enumerate(blocks))
    assert [sum(r.at == k for r in rows) for k in range(1, 5)] == blocks and rows[-1].slot < 1024
    assert mixing.schedule(spark.createDataFrame([(1, 0)], "at int, blocks long")).count() == 0
    assert [tuple(r) for r in mixing.schedule(spark.createDataFrame([(1, 1)], "at int, blocks long")).collect()] == [(0, 1, 0)]


def test_small_sources_cost_no_more_slots(spark):
    n = mixing.schedule(spark.createDataFrame([(1, 5_000), (2, 1), *((k, 1) for k in range(3, 60))], "at int, blocks long"))
    got = n.groupBy("at").count().collect()
    assert {r["at"]: r["count"] for r in got} == {1: 5_000, **dict.fromkeys(range(2, 60), 1)}


def test_mixed_comes_near_its_targets_in_order(spark, docs):
    rows = [(k, " ".join(["w"] * (1 + k % 50)), "en", "abc"[k % 3]) for k in range(600)]
    df = docs(*rows, (600, "one", "en", "tiny"))
    target = {r.source: r.target for r in mixing.mix(df).collect()}
    got = mixing.mixed(df).collect()
    taken, most = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        most[r.doc_id] = most.get(r.doc_id, 0) + 1
    assert set(target) == {"a", "b", "c", "tiny"} and all(abs(taken[s] - t) <= 50 for s, t in target.items() if s != "tiny")
    assert max(most.values()) <= 2
    # sources stand in their proportions all along
    slots = {r.doc_id: r.first_slot for r in mixing.mix(df).collect() if r.taken}
    first = [slots[k] for k in dict.fromkeys(r.doc_id for r in got if r.doc_id in slots and most[r.doc_id] == 1)]
    assert len(set(first)) > 5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_takes_the_targets(spark, sf):
    rows = queries.op5_source_mix(spark, f"{DATA}/{sf}").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()}
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert len(rows) == len(source) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = queries.op5_source_mix(spark.newSession(), f"{DATA}/{sf}").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(odd, docs):
    rows = mixing.mix(odd.withColumn("size", F.lit("a clash"))).collect()
    assert len(rows) == 10
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=4)
    assert all(r.taken <= 2 * r.size for r in rows)
    copies = mixing.mixed(odd.withColumn("size", F.lit("a clash")))
    assert copies.columns == [*odd.columns, "size"] and copies.count() > 5
    assert mixing.mix(docs((1, "x")).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs((1, None), (2, " "))).collect()] == [0, 0]


def test_no_source_is_left_out(spark, docs):
    """Large sources, small ones, and one of a single document, whose target is under half of it."""
    rows = [(1000 * k + i, "w " * 40, "en", s) for k, (s, n) in enumerate({"a": 300, "d": 300, "g": 300, "b": 12, "e": 12, "f": 12}.items()) for i in range(n)]
    df = docs(*rows, (9000, "w " * 10_000, "en", "c"), (9001, None, "en", "h"), (9002, "", "en", "c"))
    target = {r.source: r.target for r in mixing.mix(df).collect()}
    assert 0 < target["c"] < 5_000
    taken = {}
    for r in mixing.mixed(df).collect():
        taken.setdefault(r.source, []).append(len(r.text.split()))
    assert taken["c"] == [10_000] and set(taken) == set("abcdefg")
    assert all(abs(sum(taken[s]) - target[s]) <= 20 for s in "abdefg")
