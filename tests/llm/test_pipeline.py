"""The pipeline against a plain version of all its stages, and each stage on odd rows."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import sets_of
from test_mixing import filled
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import langid, mixing

DATA = "/root/testdata/sf0.001"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def told(rows, df):
    """Stage 1, text by text with the network that the stage trains."""
    net = langid.train(df)
    out = []
    for r in rows:
        if r.text and langid.LETTER.search(r.text):
            w = langid.windows(r.text.encode())
            size = (w < 256).sum(1).astype(np.float32)
            p = (net.predict(w) * size[:, None]).sum(0) / size.sum()
            out.append((r, net.languages[int(p.argmax())], float(p.max())))
    least = langid.least_score(df, net)
    return [r for r, _, score in out if score >= least - 1e-6], [r for r, _, score in out if abs(score - least) <= 1e-6]


def without_copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(low(r.text), []).append(r)
    return [max(g, key=lambda r: r.doc_id) for g in groups.values()]


def without_near(rows):
    sets, parent = [sets_of(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [r for i, r in enumerate(rows) if r.doc_id == least[find(i)]]


def taken(rows):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    words = lambda r: len(r.text.encode().split())
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(map(words, x)) for s, x in by.items()}
    out = Counter()
    for s, target in filled(sizes).items():
        goal, at = round(target), 0
        for turn in range(2):
            for r in sorted((r for r in by[s] if words(r)), key=lambda r: md5(f"42:{r.doc_id}:{md5(r.text)}")):
                part = max(0, min(at + words(r), goal) - at)
                at += words(r)
                out[r.doc_id] += part > 0 and 2 * part >= words(r)
    return +out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = df.filter("doc_id is not null").collect()
    long = [r for r in rows if r.text and len(r.text.split()) > 120][:6]
    more = [(900 + i, r.text.swapcase() if r.text.isascii() else r.text, r.lang, "x", r.n_chars) for i, r in enumerate(long)]
    more += [(920 + i, " ".join([*r.text.split()[:50], "changed", *r.text.split()[51:]]), r.lang, "y", r.n_chars) for i, r in enumerate(long)]
    more += [(940, None, "en", "x", None), (941, "", "en", None, 0), (942, "12 34 !!", "en", "x", 8), (943, " \n ", None, "x", 3)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    df.unionByName(spark.createDataFrame(more, df.schema)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_against_a_plain_version(spark, corpus):
    df = spark.read.parquet(f"{corpus}/documents.parquet")
    kept, edge = told(df.collect(), df)
    assert len({r.text for r in edge}) <= 1 and len(kept) > 180
    final = taken(without_near(without_copies(kept)))
    text = {r.doc_id: r for r in kept}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    got = corpus_pipeline.run(spark, corpus).collect()
    assert Counter(r.doc_id for r in got) == final
    for r in got:
        ids = library.encode(text[r.doc_id].text, add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens, r.source, r.lang) == (ids, len(ids), text[r.doc_id].source, text[r.doc_id].lang)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not {940, 941, 942, 943} & set(final) and len(final) < len(kept) - 6


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = odd.withColumns({c: F.lit(c) for c in ("text_", "a.b", "key", "slot", "drop", "told", "score", "sha256", "size", "order", "fp", "row")}) if name != "bpe" else odd
    done = stage(spark, clash, "")
    if name != "bpe":
        assert done.columns == clash.columns
    rows = done.collect()
    want = {"simhash_near_dedup": {1, None, 4, 5, 8, 9}, "bpe": {1, 2, None, 4, 5, 6, 7, 8, 9}}
    ids = {r.doc_id for r in rows}
    if name == "language_id":  # four short texts teach little; what has no letter goes
        assert {None, 4, 6} <= ids <= {None, 4, 5, 6, 8}
    elif name == "source_mix":
        assert ids <= {None, 4, 5, 6, 8, 9} and 4 in ids
    elif name == "exact_dedup":
        assert ids == {None, 2, 4, 6, 7, 8, 9} and sum(r.doc_id == 6 for r in rows) == 1
    else:
        assert ids == want[name]
    assert stage(spark, docs((1, "x")).limit(0), "").count() == 0


def test_mix_of_one_tiny_source_takes_no_more_slots(spark, docs):
    rows = [(k, "w " * 400, "en", "a") for k in range(40)]
    plain, tiny = (mixing.mix(docs(*rows, *more)).filter("taken > 0").agg(F.max("first_slot")).first()[0] for more in ([], [(99, "one", "en", "b")]))
    assert tiny <= 2 * max(plain, 16)
