"""Secret scans with corpus-wide ownership frequency (operator 3).

Three kinds of base spans come from patterns: assignments, access keys and long
hexadecimal runs. Beside them, every token of TOKEN characters or more that mixes
letters and digits at high entropy is a candidate. The value of each span is
hashed, and the hashes are counted over the corpus by distinct repositories and
owners. A value that OWNERS_COPIED or more owners hold is a widely copied
example; one that a single owner holds, in MOST_REPOSITORIES or fewer, looks like
a live credential of that owner; all others are shared. Candidates that look live
become spans of kind ``owned``; base spans always stay and carry their verdict.
Copies of a text count as one repository, so that they take nothing away.

Null texts count as empty and have no spans. A null owner or repository counts
as one of its own. Positions are code points, ends exclusive. Repeated rows each
get a row and count as one repository. Very long texts are scanned whole, in
proportion to their length; other columns are never looked at, whatever their
names; an empty table gives no rows. Of kinds that start at one place, the order
is that of KINDS. Hot values never meet in one task:
(value, owner, repository) are made distinct first, then counted in two steps,
and the counts return by a join of two written tables, which Spark can split.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, cut, named, raw, sha256

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: A text without one of these has no assignment.
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "owned")
LEAST_ASSIGNED = 6
#: Candidates besides: length, bits of entropy a character.
TOKEN, ENTROPY = 20, 3.5
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % TOKEN)
#: From so many owners on a value is a copied example; candidates of one owner in at most so many repositories become spans.
OWNERS_COPIED, MOST_REPOSITORIES = 3, 5
SPAN = "array<struct<start: int, kind: int, end: int, value: binary>>"


def entropy(value: bytes) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def spans_of(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, of base spans and candidates, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    covered = merged(sorted((s, e) for s, _, e, _ in out))
    at = 0
    for m in CANDIDATE.finditer(text):
        x = m[0]
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        free = at == len(covered) or covered[at][0] >= m.end()
        if free and any(48 <= c < 58 for c in x) and x.upper() != x.lower() and entropy(x) >= ENTROPY:
            out.append((m.start(), 3, m.end(), x))
    return sorted(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """How many characters stand before each of some places in a text."""
    out, at, seen = {}, 0, 0
    for p in sorted(set(places)):
        seen += len(text[at:p].decode())
        at = p
        out[p] = seen
    return out


def detect(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Add ``spans``: base spans and candidates with the hash of their value."""

    def make():
        def work(column):
            out = []
            for x in raw(column):
                found = spans_of(x)
                if found and not x.isascii():  # bytes to code points
                    chars = code_points(x, [p for s, _, e, _ in found for p in (s, e)])
                    found = [(chars[s], k, chars[e], v) for s, k, e, v in found]
                out.append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v).digest()} for s, k, e, v in found])
            kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
            return [pa.array(out, pa.list_(kind))]

        return work

    return add_columns(df, text, make, f"spans {SPAN}", keep)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories) of (value, owner, repository) rows."""
    each = found.select("value", "owner", "repository").distinct()
    owned = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, in their order."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", owner: str = "source", repository: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: doc_id, base and all spans, and how many base values are owner-specific, shared or copied.

    ``base`` and ``all`` are arrays of structs (start, kind, end, value); kind
    counts in KINDS. Without a ``repository`` column each distinct text is one.
    """
    where = sha256(F.coalesce(named(text), F.lit(""))) if repository is None else named(repository).cast("string")
    docs = df.select(named(id_col).alias("doc_id"), named(owner).cast("string").alias("owner"), where.alias("repository"), named(text).alias("text"))
    found = cut(detect(docs, "text", ["doc_id", "owner", "repository"]).withColumn("row", F.monotonically_increasing_id()))
    each = cut(found.select("row", "owner", "repository", F.explode("spans").alias("span")).withColumn("value", F.col("span.value")))
    counts = cut(ownership(each))
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    judged = each.join(counts, "value").select("row", "span", live.alias("live"), (F.col("n_owners") >= OWNERS_COPIED).alias("copied"))
    base = F.col("span.kind") < 3
    rows = judged.filter(base | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list("span")).alias("all"),
        F.count_if(base & F.col("live")).alias("n_live"),
        F.count_if(base & F.col("copied")).alias("n_copied"),
        F.count_if(base & ~F.col("live") & ~F.col("copied")).alias("n_shared"),
    )
    return found.join(rows, "row", "left").select(
        "doc_id",
        F.filter("spans", lambda s: s["kind"] < 3).alias("base"),
        F.coalesce("all", F.array().cast(SPAN)).alias("all"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )


def digest(done: DataFrame) -> DataFrame:
    """The columns of the query, from those of scan()."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return done.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), sha256(joined(F.col("base"))).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_live", "n_copied", "n_shared")
