"""Extra columns of any name change no result, and pass through where columns do."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, langid, lm_score, minhash, mixing, quality_rules, secrets, simhash, token_counts, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = ("a.b", "text_", "c0", "key", "row", "fp", "spans", "order", "slot", "host", "recipe", "word", "doc", "span", "n_words", "ids", "path", "drop", "value", "at", "score", "lang_pred")

OPERATORS = {
    "op1": lambda df: bpe.encode(df, PATH).select("doc_id", "ids"),
    "op2": lambda df: lm_score.score_corpus(df).select("doc_id", "n_words"),
    "op3": lambda df: secrets.digest(secrets.scan(df)),
    "op4": lambda df: simhash.near_duplicates(df),
    "op4 by similarity": lambda df: minhash.near_duplicates(df),
    "op5": lambda df: mixing.mix(df),
    "op6": lambda df: langid.identify(df, None).select("doc_id", "lang_pred", "score"),
    "op7": lambda df: token_counts.count(df, PATH),
    "op8": lambda df: exact_dedup.groups(df),
    "op9": lambda df: quality_rules.judge(df),
}


def plain(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_names_clash_with_nothing(odd, name):
    clash = odd.withColumns({c: F.lit(c) for c in EXTRA})
    assert plain(OPERATORS[name](clash)) == plain(OPERATORS[name](odd))


def test_urls(spark):
    rows = [(1, "http://A.com/en/1?x"), (None, "https://b.a.com/en/" + "x" * 100_000), (3, None), (3, None), (4, "nothing"), (5, "http://a.com"), (6, "http://é.com/en/#y")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("a.com", "/en/", "block"), ("a.com", "/en/", "allow"), ("com", "/en/", "block"), *((f"h{k}.net", "/" + "p" * k, "block") for k in range(1_200))], "host string, path string, verdict string")
    got = url_filter.judge(pages.withColumns({c: F.lit(c) for c in EXTRA}), listed)
    # of one rule with two verdicts the greatest; over a thousand lengths of paths are no limit
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in got.collect() if r.rule) == [(0, "b.a.com", "a.com/en/", "block"), (1, "a.com", "a.com/en/", "block"), (6, "é.com", "com/en/", "block")]
    assert got.count() == 7 and url_filter.judge(pages.limit(0), listed).count() == 0 and url_filter.judge(pages, listed.limit(0)).filter("verdict = 'allow'").count() == 7


def test_ids_that_no_vocabulary_has(spark):
    df = spark.createDataFrame([(1, [15496, None, -1, 10**9]), (2, None), (3, [])], "i long, ids array<long>").withColumn("a.b", F.lit(1))
    got = {r.i: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got[2] == got[3] == "" and got[1] == {r.i: r.decoded for r in bpe.decode(df.limit(1).withColumn("ids", F.array(F.lit(15496))), PATH).collect()}[1] != ""


def test_spans_in_proportion_to_the_text():
    text = ("é " + "0123456789abcdef" * 2 + " ").encode() * 20_000
    import time

    began = time.time()
    found = secrets.spans_of(text)
    chars = secrets.code_points(text, [p for s, _, e, _ in found for p in (s, e)])
    assert len(found) == 20_000 and time.time() - began < 2
    assert [chars[s] for s, *_ in found[:2]] == [2, 37] and secrets.merged([(0, 3), (2, 5), (5, 6)]) == [(0, 5), (5, 6)]


def test_verdicts_by_owners(docs):
    key = lambda k: f"token = {k}{'x1' * 12}"
    same = [(k, key("A") + " text", None, "one") for k in range(8)]
    many = [(20 + k, f"{key('B')} {k}", None, "one") for k in range(7)]
    two = [(40 + k, f"{key('C')} {k}", None, "ab"[k]) for k in range(2)]
    copied = [(60 + k, f"{key('D')} {k}", None, "abc"[k]) for k in range(3)]
    got = {r.doc_id: (r.n_live, r.n_shared, r.n_copied) for r in secrets.scan(docs(*same, *many, *two, *copied)).collect()}
    assert {got[k] for k in range(8)} == {(1, 0, 0)} and got[20] == got[40] == (0, 1, 0) and got[60] == (0, 0, 1)
