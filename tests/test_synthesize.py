"""Chained synthesis: against following the pairs one by one, and in few rounds for long chains."""

import random

from pyspark.sql import functions as F

from plumbline.operators import synthesize
from plumbline.operators.cuts import tables

PAIRS = "pair_idx long, target string, donor string"


def plainly(present, pairs):
    """Lineages (source, pair, origin, trail) by going through the pairs in order."""
    out = {}
    for source in sorted({s for s, _ in present}):
        clones = {}  # of an entity: (pair, origin, trail)
        for k, target, donor in sorted(pairs):
            given = [(donor, ())] if (source, donor) in present else []
            given += [(origin, (via, *trail)) for via, origin, trail in clones.get(donor, [])]
            if given:
                out[source, k] = sorted(given)
                clones.setdefault(target, []).extend((k, origin, trail) for origin, trail in given)
    return out


def followed(spark, present, pairs):
    rounds = []
    with tables(spark) as written:

        def counted(df):
            rounds.append(1)
            return written(df)

        listed, declared = spark.createDataFrame(sorted(present), "source_id string, entity string"), spark.createDataFrame(pairs, PAIRS)
        could = synthesize.emissions(listed, declared, counted)
        got = {}
        for r in synthesize.lineages(could, listed, counted).collect():
            got.setdefault((r.source_id, r.pair_idx), []).append((r.origin, tuple(r.trail)))
    return {k: sorted(v) for k, v in got.items()}, len(rounds)


def test_against_following_pairs_one_by_one(spark):
    r = random.Random(3)
    for _ in range(3):
        names = [f"e{k}" for k in range(9)]
        pairs = [(k, *r.sample(names, 2)) for k in r.sample(range(40), 16)]
        present = {(s, e) for s in "AB" for e in names if r.random() < 0.3} | {("A", "e0")}
        assert followed(spark, present, pairs)[0] == plainly(present, pairs)


def test_rounds_of_a_long_chain(spark):
    pairs = [(k, f"e{k + 1}", f"e{k}") for k in range(300)]
    got, rounds = followed(spark, {("A", "e0"), ("B", "e290")}, pairs)
    assert got == plainly({("A", "e0"), ("B", "e290")}, pairs) and rounds <= 2 * 9 + 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAIRS)
    with tables(spark) as written:
        listed = spark.createDataFrame([("A", "x")], "source_id string, entity string")
        could = synthesize.emissions(listed, none, written)
        assert could.count() == 0 and synthesize.lineages(could, listed, written).count() == 0
        assert synthesize.emissions(listed.limit(0), none.unionByName(spark.createDataFrame([(1, "a", "b")], PAIRS)), written).withColumn("n", F.lit(1)).count() == 0
