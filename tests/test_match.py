"""Names by containment: candidates of the rarest piece, against all pairs."""

import random

from pyspark.sql import functions as F

from plumbline.operators import match


def test_candidates_stay_few_where_all_keys_begin_alike(spark):
    r = random.Random(2)
    codes = sorted({f"{r.randrange(16**6):06x}" for _ in range(600)})
    aliases = spark.createDataFrame([(f"acmemodelseries{c}",) for c in codes], "alias string")
    names = spark.createDataFrame([(f"theacmemodelseries{c}turbo",) for c in codes], "name string")
    found = match.candidates_of(aliases, names)
    assert found.filter(F.col("long").contains(F.col("short"))).count() == len(codes)
    assert found.count() < 5 * len(codes)


def test_against_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 9)))
    vendors = ["acme", "zeta"]
    registry = spark.createDataFrame([(f"{v}/{word()}-{k}", k, v, word() + word(), [word() for _ in range(3)]) for k in range(40) for v in [r.choice(vendors)]], "entity string, ord int, vendor string, display string, aliases array<string>")
    rows = [(word() + " " + word(), r.choice([None, "", "Acme", "zeta"])) for _ in range(150)] + [("!!", None), ("a", "acme")]
    names = spark.createDataFrame(rows, "name string, hint string").distinct()
    keys = match.registry_keys(registry)
    got = sorted(map(tuple, match.fuzzy(names, keys).collect()), key=repr)
    listed = [(x.entity, x.ord, x.key_ord, x.compact, x.vendor) for x in keys.collect() if x.compact]
    want = []
    for n in names.select("name", "hint", match.compact_key(F.col("name")).alias("c")).collect():
        best = []
        for entity, at, key_ord, alias, vendor in listed:
            if n.c and (alias in n.c or n.c in alias):
                score = (100 if alias == n.c else min(len(alias), len(n.c))) + (20 if (n.hint or "").lower() == vendor else 0)
                if score >= max(12, len(n.c) // 2):
                    best.append((-score, at, key_ord, entity))
        if best:
            want.append((n.name, n.hint, min(best)[3], -min(best)[0]))
    assert got == sorted(want, key=repr) and len(got) > 30
