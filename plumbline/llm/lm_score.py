"""Language-model scores by masked pseudo-likelihood (operator 2).

A bidirectional window network predicts every word from the words on both
sides: the embeddings of the left and the right neighbour are added, pass a tanh
layer, and a softmax gives the word's probability. A document's score is the
sum of the logarithms over all its words.

Words are lower-cased at A-Z and mapped to classes: the commonest words of the
corpus have one each, all others share BUCKETS classes by length and ending.
The network predicts classes; a word that shares its class has the class's
probability times its own share of the class. Shares come from the counts of all
words of the corpus, a table that grows with it and is joined, never gathered.
One is added to each count and to that of unseen words, so these have a share.

Spark counts words over all documents, then all windows (left, word, right) over
all documents; these counts are the whole of what the loss needs, and they grow
with the input. Training is data-parallel in numpy: each partition of the
contexts fits its own copy, the copies are averaged by their windows in Spark,
and the next round goes on from the average; only the model, whose size is
fixed, reaches the driver.

Null and empty texts have no words, a sum of 0 and no mean. Very long texts are
scored whole. Repeated rows each get a row and count; ties among the commonest
words are broken by their bytes. An empty corpus gives an untrained model and no
rows. Other columns pass through, but for ones named like the results.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import add_columns, cut, named, raw, slices

#: Words with a class of their own, classes of the rest, size of the hidden layer.
WORDS, BUCKETS, DIM = 448, 64, 32
CLASSES = WORDS + BUCKETS
#: The neighbour of the first and of the last word.
EDGE = CLASSES
ROUNDS, EPOCHS, BATCH, RATE, SEED = 3, 2, 256, 0.01, 11
#: Steps of a round at least: partitions of few contexts pass over them again.
LEAST_STEPS = 100
#: Words whose class a task remembers.
MOST_KNOWN = 400_000
#: Counts that a task holds before it passes them on.
MOST_COUNTED = 500_000


def bucket(word: bytes) -> int:
    return WORDS + (zlib.crc32(word[-2:]) & 15) + 16 * min(3, len(word) // 4)


class Classes(dict):
    """Classes of words; what isn't in the vocabulary is put into its bucket and remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_KNOWN:
            for w in [w for w, c in self.items() if c >= WORDS]:
                del self[w]
        self[word] = c = bucket(word)
        return c


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def out():
            words, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for part in slices(batches, "text"):
            for x in raw(part.column("text")):
                held.update(x.lower().split())
            if len(held) > MOST_COUNTED:
                yield out()
        if held:
            yield out()

    return df.select(named(text).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text: str = "text", words: int = WORDS) -> list[bytes]:
    """The commonest words, ties by bytes."""
    return commonest(word_counts(df, text), words)


def commonest(counts: DataFrame, words: int = WORDS) -> list[bytes]:
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def bucket_of(word: Column) -> Column:
    """bucket() as a Column."""
    return (F.lit(WORDS) + F.crc32(F.substring(word, -2, 2)).bitwiseAND(15) + 16 * F.least(F.lit(3), F.floor(F.octet_length(word) / 4))).cast("int")


def shares(counts: DataFrame, words: list[bytes]) -> tuple[DataFrame, dict[int, float]]:
    """(word, log_share) of the words that share a class, and the logarithm of an unseen word's share of each class."""
    known = counts.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    rest = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", bucket_of(F.col("word")))
    totals = {r.bucket: r.total for r in rest.groupBy("bucket").agg((F.sum("n") + F.count("*") + 1).alias("total")).collect()}
    unseen = {b: -math.log(totals.get(b, 1)) for b in range(WORDS, CLASSES)}
    least = F.element_at(F.array(*map(F.lit, unseen.values())), F.col("bucket") - (WORDS - 1))
    return rest.select("word", (F.log(F.col("n") + 1.0) + least).alias("log_share")), unseen


def numbered(found: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number among these of every word in a row, and how many words each text has."""
    words = list(set().union(*found))
    number = dict(zip(words, range(len(words)), strict=True))
    n = np.array([len(x) for x in found], np.int64)
    return words, np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum())), n


def packed(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Packed (left, right, word) of every word, from the classes of words in a row and the number of words of each text."""
    ends = np.cumsum(n)
    left, right = np.concatenate([[EDGE], c[:-1]]) if len(c) else c, np.concatenate([c[1:], [EDGE]]) if len(c) else c
    left[(ends - n)[n > 0]] = EDGE
    right[(ends - 1)[n > 0]] = EDGE
    return (left * (CLASSES + 1) + right) * CLASSES + c


def windows(column: pa.Array, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of every word of some texts in a row, and the number of words of each text."""
    words, at, n = numbered([x.lower().split() for x in raw(column)])
    return packed(np.fromiter(map(classes.__getitem__, words), np.int64, len(words))[at], n), n


def window_counts(df: DataFrame, words: list[bytes], text: str = "text") -> DataFrame:
    """(window, n) over all texts; a window packs context and word."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        classes = Classes({w: i for i, w in enumerate(shared.value)})
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["window", "n"])
        for part in slices(batches, "text"):
            more, m = np.unique(windows(part.column("text"), classes)[0], return_counts=True)
            both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            keys, n = both, np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
            if len(keys) > 2 * MOST_COUNTED:
                yield out()
                keys = n = np.zeros(0, np.int64)
        if len(keys):
            yield out()

    return df.select(named(text).cast("string").alias("text")).mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


SHAPES = {"left": (CLASSES + 1, DIM), "right": (CLASSES + 1, DIM), "bias": (DIM,), "out": (DIM, CLASSES), "out_bias": (CLASSES,)}


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(SHAPES.items(), np.split(values, ends[:-1]), strict=True)}


def hidden(model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.tanh(model["left"][left] + model["right"][right] + model["bias"])


def logits(model, h: np.ndarray) -> np.ndarray:
    return h @ model["out"] + model["out_bias"]


def gradients(model, left, right, counts) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability; ``counts``: how often each class stands in each context."""
    h = hidden(model, left, right)
    z = logits(model, h)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    n = counts.sum(axis=1, keepdims=True)
    d = (p * n - counts) / n.sum()
    dh = (d @ model["out"].T) * (1 - h * h)
    out = {"bias": dh.sum(0), "out": h.T @ d, "out_bias": d.sum(0)}
    for side, at in (("left", left), ("right", right)):
        hot = np.zeros((len(at), CLASSES + 1), np.float32)
        hot[np.arange(len(at)), at] = 1
        out[side] = hot.T @ dh
    return out


def fit(model, keys: np.ndarray, n: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam over batches of contexts, from ``model`` on."""
    context, word = keys // CLASSES, keys % CLASSES
    contexts, row = np.unique(context, return_inverse=True)
    order = np.argsort(row, kind="stable")
    starts = np.searchsorted(row[order], np.arange(len(contexts) + 1))
    rng = np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    batches = -(-len(contexts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    total = epochs * batches
    for _ in range(epochs):
        mixed = rng.permutation(len(contexts))
        for i in range(0, len(mixed), BATCH):
            take = mixed[i : i + BATCH]
            counts = np.zeros((len(take), CLASSES), np.float32)
            for r, k in enumerate(take):
                at = order[starts[k] : starts[k + 1]]
                counts[r, word[at]] = n[at]
            step += 1
            rate = RATE * (1 - 0.8 * step / total)
            for k, g in gradients(model, contexts[take] // (CLASSES + 1), contexts[take] % (CLASSES + 1), counts).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model[k] = model[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(counts: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The average of copies that partitions fit to their contexts, round after round."""
    sc, model = counts.sparkSession.sparkContext, fresh()
    dealt = cut(counts.withColumn("context", F.expr(f"window div {CLASSES}")).repartition("context").select("window", "n"))
    for k in range(rounds):
        shared = sc.broadcast(flat(model))

        def run(batches, shared=shared, k=k):
            kept = [(b.column("window").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
            if kept:
                keys, n = (np.concatenate(x) for x in zip(*kept, strict=True))
                got = flat(fit(shaped(shared.value), keys, n.astype(np.float32), seed=SEED + k))
                at = pa.array(np.arange(len(got), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([at, pa.array(got.astype(np.float64)), pa.array(np.full(len(got), float(n.sum())))], ["at", "x", "w"])

        parts = dealt.mapInArrow(run, "at int, x double, w double")
        mean = parts.groupBy("at").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
        got = mean.toPandas()  # as many rows as the model has numbers
        if not len(got):
            break
        values = np.zeros(len(got), np.float32)
        values[got["at"].to_numpy()] = got["x"].to_numpy()
        model = shaped(values)
    return model


def normalizers(model) -> np.ndarray:
    """Logarithms of the softmax sums of all contexts: the classes bound their number."""
    side, out = CLASSES + 1, []
    for left in range(side):
        z = logits(model, hidden(model, np.full(side, left), np.arange(side)))
        top = z.max(axis=1)
        out.append(top + np.log(np.exp(z - top[:, None]).sum(axis=1)))
    return np.concatenate(out).astype(np.float32)


def log_probabilities(model, sums: np.ndarray, keys: np.ndarray) -> np.ndarray:
    context, word = keys // CLASSES, keys % CLASSES
    h = hidden(model, context // (CLASSES + 1), context % (CLASSES + 1))
    return np.einsum("nd,nd->n", h, model["out"].T[word]) + model["out_bias"][word] - sums[context]


def score(df: DataFrame, words: list[bytes], model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words and log_likelihood, the sum over all words."""
    shared = df.sparkSession.sparkContext.broadcast((words, model, normalizers(model)))

    def make():
        known, net, sums = shared.value
        classes = Classes({w: i for i, w in enumerate(known)})

        def work(column):
            keys, n = windows(column, classes)
            each, at = np.unique(keys, return_inverse=True)
            logs = log_probabilities(net, sums, each).astype(np.float64)[at]
            total = np.concatenate([[0.0], np.cumsum(logs)])
            ends = np.cumsum(n)
            return [pa.array(n), pa.array(total[ends] - total[ends - n])]

        return work

    return add_columns(df, text, make, "n_words long, log_likelihood double", keep)


def pieces(df: DataFrame, words: list[bytes], model, text: str, keep: list[str]) -> DataFrame:
    """What a document's score is summed of: (row, word, times, n_words, log_likelihood, doc).

    One piece of a row has its ``doc``, the kept columns, the score of its
    classes and a key of its own in ``word``, so that these pieces spread; the
    others have a word that shares its class, and how often it stands there.
    """
    shared = df.sparkSession.sparkContext.broadcast((words, model, normalizers(model)))
    kept = df.select(*map(named, keep))
    schema = T.StructType().add("row", "long").add("word", "binary").add("times", "long").add("n_words", "long").add("log_likelihood", "double").add("doc", kept.schema)

    def run(batches):
        known, net, sums = shared.value
        classes, own = Classes({w: i for i, w in enumerate(known)}), set(known)
        for part in slices(batches, "text"):
            each, at, n = numbered([x.lower().split() for x in raw(part.column("text"))])
            keys, where = np.unique(packed(np.fromiter(map(classes.__getitem__, each), np.int64, len(each))[at], n), return_inverse=True)
            total = np.concatenate([[0.0], np.cumsum(log_probabilities(net, sums, keys).astype(np.float64)[where])])
            ends, rows, doc = np.cumsum(n), part.column("row"), part.column("doc")
            first = [rows, pa.array([b"%d" % r for r in rows.to_pylist()], pa.binary()), pa.array(np.zeros(len(n), np.int64)), pa.array(n), pa.array(total[ends] - total[ends - n]), doc]
            yield pa.RecordBatch.from_arrays(first, schema.names)
            shares = np.fromiter((w not in own for w in each), bool, len(each))
            held = shares[at]
            found, times = np.unique(np.repeat(np.arange(len(n)), n)[held] * max(1, len(each)) + at[held], return_counts=True)
            there, m = found // max(1, len(each)), len(found)
            rest = [rows.take(pa.array(there)), pa.array(each, pa.binary()).take(pa.array(found % max(1, len(each)))), pa.array(times), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, doc.type)]
            yield pa.RecordBatch.from_arrays(rest, schema.names)

    rows = df.select(F.monotonically_increasing_id().alias("row"), named(text).cast("string").alias("text"), F.struct(*map(named, keep)).alias("doc"))
    return rows.mapInArrow(run, schema)


def score_words(df: DataFrame, words: list[bytes], model, table: DataFrame, unseen: dict[int, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As score(), with the probabilities of words themselves: ``table`` and ``unseen`` are those of shares()."""
    own = [c for c in (df.columns if keep is None else keep) if c not in ("n_words", "log_likelihood")]
    least = F.element_at(F.array(*map(F.lit, unseen.values())), bucket_of(F.col("word")) - (WORDS - 1))
    parts = pieces(df, words, model, text, own).join(table, "word", "left").withColumn("log", F.col("times") * F.coalesce("log_share", least))
    rows = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.max("log_likelihood").alias("classes"), F.sum("log").alias("log"), F.first("doc", ignorenulls=True).alias("doc"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in own], "n_words", (F.col("classes") + F.col("log")).alias("log_likelihood"))


def score_corpus(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score_words() of a model fitted to the same texts."""
    counts = cut(word_counts(df, text))
    words = commonest(counts)
    return score_words(df, words, train(window_counts(df, words, text)), *shares(counts, words), text, keep)


def fitted(df: DataFrame, text: str = "text") -> tuple[list[bytes], dict[str, np.ndarray]]:
    """Vocabulary and model of all texts of ``df``."""
    words = vocabulary(df, text)
    return words, train(window_counts(df, words, text))
