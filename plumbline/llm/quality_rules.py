"""Quality rules with host-level verdicts (operator 9).

Features of whole texts give each document its rule failures. Failures are
counted by host; a beta prior, fitted to all hosts by moments, shrinks each
host's failure rates, so that a host of few documents isn't judged by chance. A
host whose shrunk rate of any rule is over HOST_RATE is rejected, and its
verdict returns to its documents by a join.

Null texts have no words and fail as too short. A null host is a host of its
own. Repeated rows each get a row and count. Hot hosts are pre-aggregated, and
the join reads two written tables, whose skewed partitions Spark splits. An
empty table gives no rows. Very long texts are read whole; ties don't arise, as
rates and verdicts have no order. Other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, cut, named, raw

#: Fixed values of the base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: Rules of a document whose failures are counted by host: name, and when it fails.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "n_dup_lines > 0.3 * n_lines",
}
#: A host over this shrunk rate of failures is rejected.
HOST_RATE = 0.5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that are found twice or more.

    Windows that share a rolling hash are compared word by word.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = sum(h[k : k + n] * FACTORS[k] for k in range(size))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    found = Counter(tuple(words[i : i + size]) for i in at)
    inside = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if found[tuple(words[i : i + size])] > 1:
            inside[i] += 1
            inside[i + size] -= 1
    return int((np.cumsum(inside) > 0).sum())


def features_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    letters = len(b"".join(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.decode()) - (len(text) - letters),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        def work(column):
            rows = np.array([features_of(x) for x in raw(column)], np.int64).reshape(-1, len(FEATURES))
            return [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FEATURES))]

        return work

    return add_columns(df, text, make, ", ".join(f"{c} long" for c in FEATURES), keep)


def beta_prior(mean: float, spread: float, hosts: int, docs: int) -> tuple[float, float]:
    """Alpha and beta by moments: what the rates vary between hosts beyond chance."""
    between = spread - mean * (1 - mean) * hosts / max(docs, 1)
    size = min(max(mean * (1 - mean) / max(between, 1e-6) - 1, 1.0), 1e6)
    return mean * size, (1 - mean) * size


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n_docs, shrunk rate of each rule) of documents with a column for each rule's failure."""
    hosts = cut(judged.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(r).alias(r) for r in RULES]))
    n = F.sum("n_docs")
    mean = {r: (F.sum(r) / n).alias(f"{r}_mean") for r in RULES}
    square = {r: (F.sum(F.col(r) * F.col(r) / F.col("n_docs")) / n).alias(f"{r}_square") for r in RULES}
    over = hosts.agg(F.count("*").alias("hosts"), n.alias("docs"), *mean.values(), *square.values()).first()
    rates = []
    for r in RULES:
        m = over[f"{r}_mean"] or 0.0
        a, b = beta_prior(m, (over[f"{r}_square"] or 0.0) - m * m, over["hosts"], over["docs"] or 0)
        rates.append(((F.col(r) + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))).alias(r))
    return hosts.select("host", "n_docs", *rates)


def judge(df: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id", host_rate: float = HOST_RATE) -> DataFrame:
    """One row for each row of ``df``: doc_id, features, base_failed, host_failed, kept."""
    docs = df.select(named(id_col).alias("doc_id"), named(host).cast("string").alias("host"), named(text).alias("text"))
    judged = cut(features(docs, "text", ["doc_id", "host"]).withColumns({r: F.expr(x) for r, x in RULES.items()}))
    verdicts = cut(host_rates(judged).select(F.col("host").alias("__host"), (F.greatest(*RULES) > host_rate).alias("host_failed")))
    back = judged.join(verdicts, F.col("host").eqNullSafe(F.col("__host")))
    failed = F.col("short") | F.col("repeated")
    return back.select("doc_id", *FEATURES[:5], failed.alias("base_failed"), "host_failed", (~failed & ~F.col("host_failed")).alias("kept"))
