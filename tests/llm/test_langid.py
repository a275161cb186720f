import zlib

import numpy as np

from plumbline.llm import langid, queries

DATA = "/root/testdata"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id][0]]
    assert len(held) > 1500
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) > 0.98


def test_gradients_match_differences():
    net = langid.ByteCNN(["a", "b"])
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    rows = np.concatenate([langid.windows(b"some words here", 32), langid.windows("été".encode(), 32)])
    labels = np.array([0, 1])

    def loss():
        return -np.log(net.forward(rows)[0][np.arange(2), labels]).mean()

    g, before = net.gradients(rows, labels), loss()
    for name, at in [("out", (3, 1)), ("out_bias", (0,)), ("bias", (4,)), ("filters", (2, 1)), ("filters", (9, 20)), ("embedding", (ord("e"), 2))]:
        net.parts[name][at] += 1e-6
        assert abs((loss() - before) / 1e-6 - g[name][at]) < 1e-3
        net.parts[name][at] -= 1e-6


def test_whole_texts_count(docs):
    rows = [(i, ("the house and the garden " if i % 2 else "le maison été façade ") * 20, "en" if i % 2 else "fr") for i in range(60)]
    net = langid.train(docs(*rows))
    mixed = "the house and the garden " * 15 + "le maison été façade " * 200
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs((1, mixed), (2, "the garden"), (3, "!? 123")), net).collect()}
    assert got == {1: "fr", 2: "en", 3: "und"}


def test_odd_rows(odd, docs):
    rows = langid.identify(odd, langid.train(odd)).collect()
    assert len(rows) == 10
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 7, 9}
    empty = docs((1, "x")).limit(0)
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty, None).count() == 0


def test_held_out_rows_are_not_learned(docs):
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert langid.sample(docs(*((i, "some words", "en") for i in out)), "text", "lang", "doc_id").count() == 0


def test_stage_goes_by_the_score(spark, docs, odd):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(0)
    noise = ["".join(map(chr, rng.integers(33, 127, n))) for n in rng.integers(200, 3000, 60)]
    df = table.unionByName(docs(*((-1 - i, x) for i, x in enumerate(noise)), (-100, "!? 123")))
    stay = {r.doc_id for r in corpus_pipeline.in_a_language(spark, df, "").select("doc_id").collect()}
    labelled = {r.doc_id for r in table.filter("lang is not null and text rlike '[a-z]'").collect()}
    print("noise that stays", sum(-61 < d < 0 for d in stay), "labelled", len(labelled), "lost", len(labelled - stay))
    assert -100 not in stay and len(labelled - stay) <= 0.01 * len(labelled)
    assert sum(-61 < d < 0 for d in stay) < 30
    nothing = odd.withColumn("lang", odd.lang.substr(1, 0)).replace("", None, "lang")
    assert [r.doc_id for r in langid.recognized(nothing).collect()].count(6) == 2
    assert {r.doc_id for r in langid.recognized(nothing).collect()} == {None, 4, 5, 6, 8}


def test_long_texts_are_learned_from(docs):
    """Languages that stand in very long texts only, and a sample no larger for it."""
    english, french = "the house and the garden of this town ", "le maison été façade et la ville où "
    both = [(i, (english if i % 2 else french) * (1_200 + i), "en" if i % 2 else "fr") for i in range(40)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(*both), langid.train(docs(*both), most=300)).collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(40)}
    mixed = [(i, english * 3 if i % 2 else french * 1_200, "en" if i % 2 else "fr") for i in range(40)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(*mixed), langid.train(docs(*mixed))).collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(40)}
    counts = langid.sample(docs(*both), "text", "lang", "doc_id", most=70).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in counts} == {"en": 70, "fr": 70}


def plainly(net, text):
    """Probabilities of a text by loops over windows, filters and places."""
    p, total = np.zeros(len(net.languages)), 0
    n = len(net.parts["bias"])
    for at in range(0, max(1, len(text)), langid.LENGTH):
        piece = list(text[at : at + langid.LENGTH])
        held = piece + [256] * (langid.LENGTH - len(piece) + net.wide - 1)
        pooled = np.zeros(n)
        for f in range(n):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = net.parts["filters"][:, f].reshape(net.wide, langid.DIM)
            best = max(sum(float(net.parts["embedding"][held[i + j]] @ kernel[j]) for j in range(width)) for i in range(langid.LENGTH))
            pooled[f] = max(0.0, best + net.parts["bias"][f])
        logits = pooled @ net.parts["out"] + net.parts["out_bias"]
        e = np.exp(logits - logits.max())
        p, total = p + len(piece) * e / e.sum(), total + len(piece)
    return p / total


def test_query_against_plain_network(spark):
    """The query's rows are those of its trained network, computed plainly."""
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    net = langid.train(table)
    text = {r.doc_id: r.text for r in table.collect()}
    rows = [r for r in queries.op6_language_id(spark, f"{DATA}/sf0.001").collect() if text[r.doc_id] and len(text[r.doc_id]) < 700][:12]
    assert len(rows) == 12
    for r in rows:
        p = plainly(net, text[r.doc_id].encode())
        assert (r.lang_pred == "und" and r.score == 0) or (r.lang_pred == net.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-4)
