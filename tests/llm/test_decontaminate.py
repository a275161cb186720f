import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate
from plumbline.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, most):
    """(n_words, n_hit, items, code points that are cut out) of a text."""
    found = list(WORD.finditer(lowered(text)))
    words, hit, ids = [m[0] for m in found], set(), set()
    for item, other in items:
        own = WORD.findall(lowered(other))
        k = min(most, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    ids |= {str(item)} if item is not None else set()
    spans, j = [], 0
    while j < len(words):
        if j in hit:
            e = j
            while e + 1 in hit:
                e += 1
            spans.append((j, e + 1, found[j].start(), found[e].end()))
            j = e
        j += 1
    return len(words), len(hit), sorted(ids), spans


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in df.collect())


def test_suffix_order_and_search():
    r = random.Random(1)
    for _ in range(60):
        texts = [[r.randint(1, 3) for _ in range(r.randint(1, 40))] for _ in range(r.randint(1, 4))]
        seq, starts = [], []
        for x in texts:
            starts.append(len(seq))
            seq += [*x, 0]
        assert suffix_order(np.array(seq)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
        fm = FMIndex.build(np.array(seq), np.array(starts))
        phrases = [[r.randint(1, 4) for _ in range(m)] for m in (1, 2, 4, 4)]
        lo, hi = fm.search(np.array([[-1] * (4 - len(p)) + p for p in phrases]))
        for p, a, b in zip(phrases, lo, hi, strict=True):
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq)) if seq[i : i + len(p)] == p]
    assert suffix_order(np.ones(5_000, np.int64)).tolist() == list(range(4_999, -1, -1))


@pytest.mark.parametrize(("size", "block"), [(decontaminate.SHARD_BYTES, decontaminate.BLOCK_BYTES), (60, 10**6), (90, 120)])
def test_against_brute_force(spark, docs, size, block):
    """Whole shards, texts that are cut into pieces, and several blocks of items."""
    r = random.Random(3)
    words = ["a", "bb", "CC", "d4", "é日", "f" * 40]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n", "-" * 70]) for _ in range(n))
    items = [(k, text(r.randint(1, 9))) for k in range(12)] + [(3, "bb bb bb"), (None, "d4 a d4"), (20, None), (21, " - ")]
    given = [(k, text(r.randint(0, 60))) for k in range(25)] + [(4, None), (4, ""), (None, "x BB bb bb y"), (30, "bb " * 500), (31, "bb " * 500), (31, "bb " * 500)]
    got = decontaminate.decontaminate(docs(*given), spark.createDataFrame(items, ITEMS), most=3, size=size, block=block)
    assert rows_of(got) == sorted(((i is None, i or 0), *brute(t, items, 3)) for i, t in given)


def test_query_parameters_and_removal(spark, docs):
    passage = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, passage), (10, "only short ones"), (2, passage + " more")], ITEMS)
    df = docs((1, f"Before. {passage.upper()}! After."), (2, "not, ONLY Short\tones."), (3, passage[:-4]), (4, "clean"))
    got = decontaminate.decontaminate(df, items)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == {1: (12, ["1", "2"]), 2: (3, ["10"]), 3: (11, ["1", "2"]), 4: (0, [])}
    clean = df.join(got.select("doc_id", "spans"), "doc_id").select("doc_id", decontaminate.without_spans(F.col("text"), F.col("spans")).alias("text"))
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "Before. ! After.", 2: "not, .", 3: "", 4: "clean"}


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "the cat sat"), (2, "null id")], ITEMS)
    want = rows_of(decontaminate.decontaminate(odd, items))
    assert len(want) == 10 and sum(x[2] for x in want) == 3 * 20_000 + 3 * 3 + 2
    clash = odd.withColumns({c: F.lit(c) for c in ("id", "row", "item", "items", "spans", "first", "n_words", "a.b", "block")})
    assert rows_of(decontaminate.decontaminate(clash, items.withColumn("item", F.lit(0)))) == want
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(odd, items.limit(0)).collect()} == {0}
