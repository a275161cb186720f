import numpy as np
import pytest

from plumbline.llm import lm_score as lm


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    pairs = [("red", "apple"), ("green", "leaf"), ("blue", "sky")]
    return [" ".join(f"the {a} {b} is" for a, b in (pairs[i] for i in rng.integers(0, 3, 60))) for _ in range(120)]


def test_counts_are_those_of_all_windows(docs, corpus):
    df = docs(*((i, t) for i, t in enumerate(corpus[:20])), (98, None), (99, "  "))
    words = {bytes(r.word): r.n for r in lm.word_counts(df).collect()}
    assert words[b"the"] == 20 * 60 and len(words) == 8
    known = lm.vocabulary(df)
    assert known[:2] == [b"is", b"the"]
    counts = lm.window_counts(df, known).collect()
    assert sum(r.n for r in counts) == 20 * 240
    code = {w.decode(): i for i, w in enumerate(known)}
    first = (lm.EDGE * (lm.CLASSES + 1) + code["red"]) * lm.CLASSES + code["the"]
    assert {r.window: r.n for r in counts}.get(first, 0) == sum(t.startswith("the red") for t in corpus[:20])


def test_scores_are_the_sums_of_conditional_probabilities(docs, corpus):
    df = docs(*((i, t) for i, t in enumerate(corpus)), (200, "sky the is leaf apple red the the"), (201, None), (201, ""), (202, "zzz"))
    words, model = lm.fitted(df)
    rows = {(r.doc_id, r.text): r for r in lm.score(df, words, model).collect()}
    assert len(rows) == 124
    classes = lm.Classes({w: i for i, w in enumerate(words)})
    for key in [(0, corpus[0]), (200, "sky the is leaf apple red the the"), (202, "zzz")]:
        c = [lm.EDGE, *(classes[w] for w in key[1].encode().split()), lm.EDGE]
        want = 0.0
        for i in range(1, len(c) - 1):
            z = lm.logits(model, lm.hidden(model, np.array([c[i - 1]]), np.array([c[i + 1]])))[0].astype(float)
            want += z[c[i]] - np.log(np.exp(z).sum())
        assert rows[key].log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert rows[201, None].n_words == 0 and rows[201, ""].log_likelihood == 0
    mean = {k: r.log_likelihood / r.n_words for k, r in rows.items() if r.n_words}
    natural = np.mean([mean[i, t] for i, t in enumerate(corpus)])
    assert natural > -1.5 > mean[200, "sky the is leaf apple red the the"]


def test_gradients_match_differences():
    model = {k: v.astype(np.float64) for k, v in lm.fresh().items()}
    left, right = np.array([1, 5]), np.array([2, 5])
    counts = np.zeros((2, lm.CLASSES))
    counts[0, 3], counts[1, 7] = 2, 1

    def loss(m):
        z = lm.logits(m, lm.hidden(m, left, right))
        return -(counts * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum() / counts.sum()

    g = lm.gradients(model, left, right, counts)
    for name, at in [("left", (5, 3)), ("right", (2, 1)), ("bias", (4,)), ("out", (3, 7)), ("out_bias", (3,))]:
        more = {k: v.copy() for k, v in model.items()}
        more[name][at] += 1e-5
        assert (loss(more) - loss(model)) / 1e-5 == pytest.approx(g[name][at], rel=1e-2, abs=1e-5)


def test_empty_corpus_and_odd_rows(docs, odd):
    empty = docs((1, "x")).limit(0)
    assert lm.score(empty, *lm.fitted(empty)).count() == 0
    words, model = lm.fitted(odd)
    rows = lm.score(odd, words, model).collect()
    assert len(rows) == 10 and max(r.n_words for r in rows) == 120_000


def test_words_of_a_bucket_have_their_own_probability(docs):
    common = " ".join(f"c{i} c{i}" for i in range(lm.WORDS))  # these take all classes of their own
    often, seldom = b"xyzq1", b"abzq1"
    assert lm.bucket(often) == lm.bucket(seldom)
    rows = [(i, f"{common} {common}") for i in range(3)] + [(10, "c1 xyzq1 c2"), (11, "c1 abzq1 c2"), (11, "c1 abzq1 c2"), (12, None), (13, "xyzq1 xyzq1 é日"), (14, "a")]
    df = docs(*rows)
    counts = lm.word_counts(df)
    words = lm.commonest(counts)
    model = lm.fresh()
    table, unseen = lm.shares(counts, words)
    n = {bytes(r.word): r.n for r in counts.collect() if bytes(r.word) not in words}
    total = {b: 1 + sum(k + 1 for w, k in n.items() if lm.bucket(w) == b) for b in unseen}
    share = lambda w: np.log((n.get(w, 0) + 1) / total[lm.bucket(w)])
    more = docs(*rows, (15, "c1 unseen1 c2"))
    plain = lm.score(more, words, model, keep=["doc_id"]).collect()
    want = sorted((r.doc_id, r.n_words, pytest.approx(r.log_likelihood + sum(share(w) for d, t in {*rows, (15, "c1 unseen1 c2")} if d == r.doc_id for w in (t or "").encode().split() if w not in words), abs=1e-6)) for r in plain)
    got = sorted((r.doc_id, r.n_words, r.log_likelihood) for r in lm.score_words(more, words, model, table, unseen, keep=["doc_id"]).collect())
    assert len(got) == len(rows) + 1 and got == want
    done = {r.doc_id: r.log_likelihood for r in lm.score_corpus(df, keep=["doc_id"]).collect()}
    assert done[10] > -1e9 and done[11] - done[10] == pytest.approx(share(seldom) - share(often), abs=1e-4)


def test_query_against_its_model_gathered(spark, monkeypatch):
    """Every row of the query is the sum of its trained model's conditional log-probabilities, word by word, with shares from plain counts."""
    from collections import Counter

    from plumbline.llm import queries

    kept, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda counts, *more: kept.append(train(counts, *more)) or kept[-1])
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op2_pseudo_likelihood(spark, folder).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    found = {d: x.translate(fold).split() for d, x in texts.items()}
    n = Counter(w for x in found.values() for w in x)
    words = sorted(n, key=lambda w: (-n[w], w))[: lm.WORDS]
    place = {w: k for k, w in enumerate(words)}
    class_of = lambda w: place[w] if w in place else lm.bucket(w)
    total = Counter()
    for w in n:
        if w not in place:
            total[lm.bucket(w)] += n[w] + 1
    model, known = {k: v.astype(np.float64) for k, v in kept[0].items()}, {}

    def log(left, word, right):
        if (left, right) not in known:
            z = lm.logits(model, lm.hidden(model, np.array([left]), np.array([right])))[0]
            known[left, right] = z - z.max() - np.log(np.exp(z - z.max()).sum())
        return known[left, right][word]

    assert set(rows) == set(found)
    for d, x in found.items():
        c = [lm.EDGE, *map(class_of, x), lm.EDGE]
        want = sum(log(c[i], c[i + 1], c[i + 2]) for i in range(len(x)))
        want += sum(np.log((n[w] + 1) / (total[lm.bucket(w)] + 1)) for w in x if w not in place)
        assert rows[d].n_words == len(x) and rows[d].log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-2)
