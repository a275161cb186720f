import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import queries, token_counts
from plumbline.llm.common import table

DATA = "/root/testdata"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lines(text):
    at, out = 0, []
    for line in (text or "").split("\n"):
        end = min(at + len(line) + 1, len(text or ""))
        if end > at:
            out.append((at, end))
        at = end
    return out


def test_query_against_the_librarys_offsets(spark, library):
    got = {}
    for r in queries.op7_section_tokens(spark, f"{DATA}/sf0.001").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    for r in table(spark, f"{DATA}/sf0.001", "documents").collect():
        offsets = library.encode(r.text or "", add_special_tokens=False).offsets
        want = []
        for i, (s, e) in enumerate(lines(r.text)):
            own = [o for o in offsets if s <= o[0] < e]
            want.append((i, s, e, len(own), sum(o[1] > e for o in own)))
        assert sorted(got.get(r.doc_id, [])) == want


def test_rules_share_out_all_tokens(docs, library):
    text = "ab\n\ncd  é日\n\n\nxyz"
    n = len(library.encode(text, add_special_tokens=False).ids)
    for rule in token_counts.RULES:
        rows = token_counts.count(docs((1, text)), PATH, rule=rule).collect()
        assert sum(r.n_tokens for r in rows) == n
    spans = docs((1, "hello world again"), (2, None)).withColumn("s", F.expr("array(named_struct('start', 0, 'end', 8), named_struct('start', 5, 'end', 11), named_struct('start', 3, 'end', 99))"))
    got = {(r.section, rule): (r.start, r.end, r.n_tokens, r.n_crossing) for rule in token_counts.RULES for r in token_counts.count(spans, PATH, sections="s", rule=rule).filter("doc_id = 1").collect()}
    assert got[0, "first"] == (0, 8, 2, 1) and got[0, "last"] == (0, 8, 1, 0)
    assert got[1, "first"] == (5, 11, 1, 0) and got[2, "first"] == (3, 17, 2, 0) and got[2, "last"] == (3, 17, 3, 1)


def test_odd_rows(odd, docs, library):
    rows = token_counts.count(odd, PATH).collect()
    assert {r.doc_id for r in rows} == {None, 4, 5, 6, 7, 8, 9}
    assert sum(r.doc_id == 6 for r in rows) == 2
    long = "The cat sat on the mat " * 20_000
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) == len(library.encode(long).ids)
    assert token_counts.count(docs((1, "x")).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(odd, PATH, rule="none")


def test_overlapping_and_equal_sections_under_odd_names(docs, library):
    text = "hello wörld again"
    tokens = library.encode(text, add_special_tokens=False).offsets
    spans = [(0, 5), (3, 12), (3, 12), (12, 12), (9, 4), (5, 99), (-3, 2)]
    df = docs((1, text)).withColumn("a`b.c", F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in spans]))
    got = {r.section: (r.start, r.end, r.n_tokens, r.n_crossing) for r in token_counts.count(df, PATH, sections="a`b.c").collect()}
    for k, (s, e) in enumerate(spans):
        s, e = max(s, 0), min(e, len(text))
        own = [t for t in tokens if s <= t[0] < e]
        assert got[k][0] == s and got[k][1] == e and got[k][2:] == (len(own), sum(t[1] > e for t in own))
