"""Language identification by a byte convolutional network (operator 6).

Bytes are embedded; filters of several widths run over a window of fixed
length, the largest value of each over the window is kept, and a softmax layer
turns these into languages. The network is trained in numpy on the driver, on a
bounded sample of labelled rows: of each of the LANGUAGES commonest languages at
most DOCS documents, the first in the order of a hash of their doc_id whatever
their length, and of their windows at most WINDOWS, the first in the order of a
hash, so that long texts are drawn from over their whole length. That is 100 MB
of windows at most on the driver, kept as 16-bit numbers for twice that. Every
text is then cut into windows from start to end; they go through the network in
batches, and a document's probabilities are the mean over its windows, weighted
by their bytes.

Null texts and texts without a letter are ``und`` with score 0. Without any
labelled row everything is ``und``. Repeated rows each get a row; a null doc_id
counts as the text "" when rows are held out. Of languages of equal probability
the first by code point is told. Very long texts are read whole, window by window.
An empty table gives no rows; other columns pass through, but for ones named like
the results. The network sees text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, free, named, raw, slices

#: Bounds of the training sample: documents of a language, languages, windows of a language.
DOCS, LANGUAGES, WINDOWS = 150, 200, 2_000
#: Shape of the network.
LENGTH, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Training.
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.004, 7
UNKNOWN = "und"
#: Windows that go through the network at a time.
AT_ONCE = 128
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def windows(text: bytes, length: int = LENGTH) -> np.ndarray:
    """A text's bytes in rows of ``length``; 256 stands behind its end."""
    n = max(1, -(-len(text) // length))
    out = np.full(n * length, 256, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, length)


class ByteCNN:
    """Embedding, one bank of filters for each width, maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.wide = languages, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        scale = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        embedding = (rng.standard_normal((257, DIM)) * 0.5).astype(np.float32)
        embedding[256] = 0
        filters = scale(self.wide * DIM, n)
        #: Narrower filters are wide ones with zeros behind, so one product serves all widths.
        self.mask = np.zeros((self.wide, DIM, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(self.wide * DIM, n)
        self.parts = {"embedding": embedding, "filters": filters * self.mask, "bias": np.zeros(n, np.float32), "out": scale(n, len(languages)), "out_bias": np.zeros(len(languages), np.float32)}

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """Each place of each window with the places behind it, embedded."""
        padded = np.concatenate([rows, np.full((len(rows), self.wide - 1), 256, rows.dtype)], axis=1)
        x = self.parts["embedding"][padded]
        b, _, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (b, rows.shape[1], self.wide * d), (s[0], s[1], s[2])).reshape(-1, self.wide * d)

    def forward(self, rows: np.ndarray):
        x = self.patches(rows)
        z = (x @ self.parts["filters"]).reshape(*rows.shape, -1)
        top = z.max(axis=1) + self.parts["bias"]
        pooled = np.maximum(top, 0)
        logits = pooled @ self.parts["out"] + self.parts["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True), pooled, z, x

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(rows[i : i + AT_ONCE])[0] for i in range(0, len(rows), AT_ONCE)])

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, pooled, z, x = self.forward(rows)
        p[np.arange(len(rows)), labels] -= 1
        p /= len(rows)
        d_top = (p @ self.parts["out"].T) * (pooled > 0)
        at = z.argmax(axis=1)  # the place that each filter's maximum comes from
        b, n = at.shape
        chosen = x.reshape(b, rows.shape[1], -1)[np.arange(b)[:, None], at]  # b, n, wide * DIM
        d_filters = np.einsum("bn,bnd->dn", d_top, chosen) * self.mask
        d_x = (d_top[:, :, None] * self.parts["filters"].T[None]).reshape(b, n, self.wide, DIM)
        padded = np.concatenate([rows, np.full((b, self.wide - 1), 256, rows.dtype)], axis=1)
        seen = padded[np.arange(b)[:, None, None], at[:, :, None] + np.arange(self.wide)]
        d_embedding = np.stack([np.bincount(seen.ravel(), d_x[..., d].ravel(), 257) for d in range(DIM)], axis=1)
        d_embedding[256] = 0
        return {"embedding": d_embedding.astype(np.float32), "filters": d_filters, "bias": d_top.sum(0), "out": pooled.T @ p, "out_bias": p.sum(0)}

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.parts.items()}
        v = {k: np.zeros_like(x) for k, x in self.parts.items()}
        step, total = 0, epochs * -(-len(rows) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                take = order[i : i + BATCH]
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for k, g in self.gradients(rows[take], labels[take]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.parts[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def pieces_of(df: DataFrame, most: int) -> DataFrame:
    """(lang, doc_id, nth, piece) of (lang, doc_id, text): a text's windows, of more than ``most`` those that a hash of their number puts first."""

    def run(batches):
        for batch in slices(batches, "text"):
            for k, text in enumerate(raw(batch.column("text"))):
                n = max(1, -(-len(text) // LENGTH))
                hashed = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                nth = np.arange(n) if n <= most else np.sort(np.argpartition(hashed ^ hashed >> np.uint64(29), most)[:most])
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(pa.array(np.zeros(len(nth), np.int64))) for c in ("lang", "doc_id")), pa.array(nth, pa.int64()), pa.array([text[i * LENGTH : (i + 1) * LENGTH] for i in nth.tolist()], pa.binary())], ["lang", "doc_id", "nth", "piece"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("lang", "doc_id", "text").mapInArrow(run, f"lang string, doc_id {kind}, nth long, piece binary")


def sample(df: DataFrame, text: str, lang: str, id_col: str, docs: int = DOCS, languages: int = LANGUAGES, most: int = WINDOWS) -> DataFrame:
    """(lang, doc_id, nth, piece): windows of labelled documents that aren't held out, within the bounds above."""
    rows = df.select(named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text"), named(id_col).alias("doc_id")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    keys = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("order")).distinct().join(F.broadcast(chosen), "lang")
    keyed = keys.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= docs).select("lang", F.col("doc_id").alias("id"))
    # the texts are read again for the few chosen documents alone; a null id is an id
    own = rows.join(F.broadcast(keyed.withColumnRenamed("lang", "of")), (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "nth", "piece"), "doc_id", "nth", "piece")
    return pieces_of(own, most).distinct().withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= most)


def train(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", docs: int = DOCS, most: int = WINDOWS) -> ByteCNN | None:
    """A network fitted on the bounded sample; None if there is no labelled row. Runs the jobs that gather the sample."""
    got = sample(df, text, lang, id_col, docs, most=most).select("lang", "place", "piece").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, r.place))
    languages = sorted({r.lang for r in got})
    at = {x: k for k, x in enumerate(languages)}
    cuts = [windows(bytes(r.piece)) for r in got]
    return ByteCNN(languages).fit(np.concatenate(cuts), np.array([at[r.lang] for r in got]))


def identify(df: DataFrame, network: ByteCNN | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its probability to the rows of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value

        def work(column):
            found: list[tuple[str, float]] = []
            held = raw(column)
            real = [net is not None and bool(LETTER.search(x.decode())) for x in held]
            cuts = [windows(x) for x, ok in zip(held, real, strict=True) if ok]
            if cuts:
                p = net.predict(np.concatenate(cuts))
                size = np.concatenate([(c < 256).sum(axis=1) for c in cuts]).astype(np.float32)
                starts = np.cumsum([0, *[len(c) for c in cuts[:-1]]])
                mean = np.add.reduceat(p * size[:, None], starts, axis=0) / np.add.reduceat(size, starts)[:, None]
                best = mean.argmax(axis=1)
                found = [(net.languages[b], float(min(1.0, mean[i, b]))) for i, b in enumerate(best)]
            each = iter(found)
            done = [next(each) if ok else (UNKNOWN, 0.0) for ok in real]
            return [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())]

        return work

    return add_columns(df, text, make, "`{}` string, `{}` double".format(*names), keep)


def least_score(df: DataFrame, network: ByteCNN, text: str = "text", lang: str = "lang", id_col: str = "doc_id", lost: float = 0.001) -> float:
    """The score that all but ``lost`` of the held-out documents reach whose language is told right; 0 if there are none."""
    fold = df.filter(held_out(named(id_col)) & named(lang).isNotNull()).select(named(lang).alias("lang"), named(text).alias("text"))
    right = identify(fold, network, "text", ["lang"]).filter("lang = lang_pred and score > 0")
    return right.agg(F.percentile_approx("score", lost, 10_000).alias("least")).first().least or 0.0


def recognized(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that have a letter and a score as held-out documents have; any with a letter if nothing can be learned."""
    network = train(df, text, lang, id_col)
    if network is None:
        return df.filter(F.coalesce(named(text), F.lit("")).rlike(r"\p{L}"))
    least = least_score(df, network, text, lang, id_col)
    told, score = free(df, "told"), free(df, "score")
    done = identify(df, network, text, names=(told, score))
    return done.filter((F.col(told) != UNKNOWN) & (F.col(score) >= least)).select(*map(named, df.columns))
