import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, rank, i if there else None, -s) for rank, (s, there, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_all_scores(spark, docs):
    """Skewed terms, ties, repeated rows, terms of case and other scripts; few best ones, so that lists are cut."""
    r = random.Random(5)
    words = ["The", "the", "of", "Ünï", "日本", "x1"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.12)), len(words) - 1)] + r.choice(["", ",", "_a"]) for _ in range(n))
    given = [(k, text(r.randint(1, 60))) for k in range(300)]
    given += [(500 + k, given[k % 5][1]) for k in range(40)] + [(7, given[7][1]), (None, given[8][1]), (800, None), (801, ""), (802, "?!")]
    items = [(k, text(r.randint(1, 25))) for k in range(20)] + [(3, text(4)), (None, text(5)), (90, None), (91, "nowhere"), (92, "the")]
    for k in (1, 4, 50):
        got = lexical.search(docs(*given), spark.createDataFrame(items, ITEMS), k=k)
        assert rows_of(got) == brute(given, items, k)


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "cat words null"), (2, "sat")], ITEMS)
    want = rows_of(lexical.search(odd, items))
    assert want == brute([(x.doc_id, x.text) for x in odd.collect()], [(1, "cat words null"), (2, "sat")], 50) and want
    clash = odd.withColumns({c: F.lit(c) for c in ("term", "terms", "doc", "item", "name", "n", "tf", "score", "rank", "a.b")})
    assert rows_of(lexical.search(clash, items.withColumn("item", F.lit(0)))) == want
    assert lexical.search(odd.limit(0), items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
