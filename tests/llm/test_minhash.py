import random

import corpus_pipeline
from plumbline.llm import minhash


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(seed=1):
    """Texts with copies at many similarities around 0.8, a chain and a star of copies that are alike through their base alone."""
    r, out = random.Random(seed), []
    word = lambda: "w%d" % r.randrange(3000)
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 300))]
        out.append(base)
        for _ in range(4):
            copy = list(base)
            for i in r.sample(range(len(copy)), r.randint(1, max(2, len(copy) // 25))):
                copy[i] = word()
            out.append(copy)
            base = copy if r.random() < 0.5 else base
    base = [word() for _ in range(300)]
    for _ in range(60):
        copy = list(base)
        for i in r.sample(range(300), 6):
            copy[i] = word()
        out.append(copy)
    out.append(base)
    r.shuffle(out)
    return [" ".join(x) for x in out]


def test_stage_against_all_pairs(spark, docs):
    texts = [*near_copies(), "a b c", "A  b c", "a b d", None, " \n", "x"]
    sets, parent = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(len(texts)) if find(i) == i}
    assert 20 < len(want) < len(texts) - 80
    got = corpus_pipeline.without_near_copies(spark, docs(*enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_odd_rows(odd, docs):
    assert {r.doc_id for r in minhash.deduplicated(odd).collect()} == {1, None, 4, 5, 8, 9}
    assert minhash.deduplicated(docs((1, "x")).limit(0)).count() == 0
