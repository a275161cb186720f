import random
import re
from collections import Counter

from plumbline.llm import quality_rules as q
from plumbline.llm import queries
from plumbline.llm.common import table

DATA = "/root/testdata"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_features_against_brute_force():
    r = random.Random(4)
    texts = ["", "a b\nc d\na b\n\n \n\n", "x " * 9, "é日 # |\x0b\x1c\x85 z"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += ["\n".join(r.choice(["one two", "three", " ", ""]) for _ in range(30)) for _ in range(20)]
    for t in texts:
        assert q.features_of(t.encode())[:5] == brute(t)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, f"{DATA}/sf0.01").collect()}
    rows = table(spark, f"{DATA}/sf0.01", "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        x, want = got[r.doc_id], brute(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x.kept and x.base_failed)


def test_host_verdicts_shrink_and_return(docs):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "en", f"h{i % 10}") for i in range(500)]
    rows += [(1000 + i, good if i % 5 == 0 else "short", "en", "bad") for i in range(100)]
    rows += [(2000, "short", "en", "small"), (2001, good, "en", "small")]
    got = {r.doc_id: r for r in q.judge(docs(*rows)).collect()}
    assert len(got) == len(rows)
    assert all(r.host_failed == (1000 <= i < 2000) for i, r in got.items())
    assert not got[1000].kept and not got[1000].base_failed and got[0].kept and got[2001].kept and not got[2000].kept


def test_odd_rows(odd, docs):
    rows = q.judge(odd).collect()
    assert len(rows) == 10 and max(r.n_words for r in rows) == 120_000
    assert q.judge(docs((1, "x")).limit(0)).count() == 0
