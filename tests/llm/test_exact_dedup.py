import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_chunks_are_the_text_and_follow_its_content(docs):
    r = random.Random(2)
    text = " ".join(r.choice(["the", "rain", "stone", "x1", "and", "fall", "red", "is"]) for _ in range(9000))
    later = "a new start of another length " + text
    rows = docs((1, text), (2, later), (3, "日本語" * 9000), (4, ""), (5, "x" * 30_000)).select("doc_id", "text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    cut = {x.doc_id: x.c for x in rows}
    assert all("".join(x.c) == x.text and all(0 < len(c) <= exact_dedup.MOST for c in x.c) for x in rows)
    assert len(set(cut[1]) & set(cut[2])) > 0.8 * len(cut[1])


def test_groups_against_a_dictionary(docs):
    r = random.Random(3)
    pool = [" ".join(r.choice(["Aa", "bB", "é", "Ä"]) for _ in range(r.randint(0, 2500))) for _ in range(20)]
    rows = [(i, r.choice([str.upper, str.lower, str])(r.choice(pool)) if i % 7 else r.choice(pool)) for i in range(200)]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for x in exact_dedup.groups(docs(*rows)).collect():
        t = lower(dict(rows)[x.doc_id])
        own = groups[t]
        assert (x.keep_id, x.group_size, x.kept) == (max(own), len(own), x.doc_id == max(own))
        assert x.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_an_identifier_that_clashes_is_not_trusted(docs):
    df = docs((1, "one"), (2, "two"), (3, "ONE"))
    weak = lambda chunk: F.substring(chunk, 2, 0).cast("binary")
    got = {x.doc_id: x.keep_id for x in exact_dedup.groups(df, make=weak).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_odd_rows(odd, docs):
    rows = exact_dedup.groups(odd).collect()
    assert len(rows) == 10
    assert {(x.doc_id, x.keep_id) for x in rows if x.doc_id in (1, 2, 5, 6)} == {(1, 2), (2, 2), (5, 6), (6, 6)}
    assert sum(x.kept for x in rows) == 7 and sum(x.kept for x in rows if x.doc_id == 6) == 1
    stay = exact_dedup.deduplicated(odd.withColumn("group_size", F.lit("a clash")))
    assert stay.columns == [*odd.columns, "group_size"]
    assert sorted((x.doc_id or 0) for x in stay.collect()) == [0, 2, 4, 6, 7, 8, 9]
    assert exact_dedup.groups(docs((1, "x")).limit(0)).count() == 0
    assert exact_dedup.deduplicated(docs((1, "x")).limit(0)).count() == 0
