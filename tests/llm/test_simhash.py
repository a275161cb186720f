import random

import pytest
import xxhash

from plumbline.llm import queries, simhash
from plumbline.llm.common import table

DATA = "/root/testdata"


def fingerprint(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = low.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids):
    """Components by comparing all pairs."""
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for f, d in zip(prints, ids, strict=True):
        least[find(f)] = min(least.get(find(f), d), d)
    return {(d, f): least[find(f)] for f, d in zip(prints, ids, strict=True)}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def planted(n, seed, crowd=0):
    """Fingerprints with chains, stars and near misses."""
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        f = r.getrandbits(64)
        out.add(f)
        for _ in range(r.randint(0, 6)):
            f ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                f ^= 1 << r.randrange(64)
            out.add(f)
    base = r.getrandbits(64)
    for _ in range(crowd):
        f = base
        for _ in range(r.randint(0, 5)):
            f ^= 1 << r.randrange(32)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("most", [256, 8])
def test_components_against_all_pairs(spark, most):
    prints = planted(60, 3, crowd=150)
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    pairs = simhash.links(df, most)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert all(a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    if most > 200:
        assert found == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    root = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = roots(prints, [signed(f) for f in prints])
    assert {f: root.get(signed(f), signed(f)) for f in prints} == {f: want[signed(f), f] for f in prints}


def test_long_chain(spark):
    chain = [sum(1 << b for b in range(k)) for k in range(64)]
    df = spark.createDataFrame([(signed(f),) for f in chain], "fp long")
    got = simhash.components(simhash.links(df)).collect()
    assert len(got) == 64 and {r.root for r in got} == {min(map(signed, chain))}


def test_query_against_all_pairs(spark):
    rows = table(spark, f"{DATA}/sf0.01", "documents").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = roots(prints, [r.doc_id for r in rows])
    got = queries.op4_simhash_near_dedup(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want


def test_near_texts_and_odd_rows(docs, odd):
    r = random.Random(5)
    words = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(20_000)]
    near = " ".join([*words[:10_000], "x", *words[10_001:]])
    df = docs((10, " ".join(words)), (3, near), (7, " ".join(words).upper()), (8, "quite another text"), (5, None), (4, " \n"))
    prints = {10: fingerprint(" ".join(words)), 3: fingerprint(near)}
    linked = (prints[10] ^ prints[3]).bit_count() <= 2
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    assert got == {10: 3 if linked else 7, 3: 3, 7: 3 if linked else 7, 8: 8, 5: 4, 4: 4}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {x.component_id for x in rows if x.doc_id in (1, 2, 7)} == {1}
    assert {x.doc_id for x in simhash.deduplicated(odd).collect()} == {1, None, 4, 5, 8, 9}
    assert simhash.near_duplicates(docs((1, "x")).limit(0)).count() == 0
