import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def proof(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = range(i // fanout * fanout, min(i // fanout * fanout + fanout, len(level)))
        out.append(([level[k] for k in run if k < i], [level[k] for k in run if k > i]))
        i //= fanout
    return out


def brute(rows, fanout, tampered):
    """(doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])], fanout) for k in names}
    top = tree([trees[k][-1][0] for k in names], fanout)
    out = []
    for place, name in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(by[name], key=lambda x: x[:3])):
            steps = proof(trees[name], i, fanout) + proof(top, place, fanout)
            acc = leaf(*row[:3], row[3] + 1, row[4]) if row[0] in tampered and row[3] is not None else own
            for left, right in steps:
                acc = h(*left, acc, *right)
            out.append((row[0], own, trees[name][-1][0], top[-1][0], [x for left, right in steps for x in left + right], acc))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [p["hash"] for p in r.proof], r.folded_root) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_against_plain_trees(docs, fanout, levels):
    """Trees built in one round and in many, of one, two and more leaves, with nodes that stand alone."""
    r = random.Random(8)
    rows = [(k, f"text {k} é", r.choice(["en"] * 6 + ["de", None]), r.choice("ab")) for k in range(70)] + [(100, "one", "fr"), (101, "a", "it"), (102, "b", "it")]
    df = docs(*rows).withColumn("n_chars", F.when(F.col("doc_id") != 14, F.col("n_chars")))
    tampered = F.col("doc_id") % 7 == 0
    plain = [(x.doc_id, x.source, x.lang, x.n_chars, x.text) for x in df.collect()]
    done = merkle.manifest(df, tampered={"n_chars": F.col("n_chars") + 1}, when=tampered, fanout=fanout, levels=levels)
    assert got(done) == brute(plain, fanout, set(range(0, 200, 7)))
    assert {x.doc_id for x in done.filter("not verified").collect()} == {k for k in range(0, 70, 7) if k != 14}


def test_odd_rows_and_empty_tables(spark, odd):
    plain = [(x.doc_id, x.source, x.lang, x.n_chars, x.text) for x in odd.collect()]
    assert got(merkle.manifest(odd)) == brute(plain, 2, set())
    clash = odd.withColumns({c: F.lit(c) for c in ("tree", "index", "level", "hash", "key", "n", "seen", "range", "block", "leaf", "a.b")})
    assert got(merkle.manifest(clash)) == got(merkle.manifest(odd))
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = merkle.manifest(odd.filter("doc_id = 4")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof == []
