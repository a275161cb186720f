"""Token counts of sections by offset-mapped attribution (operator 7).

A whole document is encoded once. Each token has the span of bytes that it
spells, so a section's tokens are those whose anchor lies within the section: an
interval join of two sorted lists in each document. A token that crosses a
boundary thus goes to one section by an explicit rule:

- ``first``: the section of its first character (the default),
- ``last``: the section of its last character,
- ``middle``: the section of its middle byte, the earlier of two.

Sections that tile a text therefore share out all of its tokens. Without a
column of sections, a section is a line with the line feed that ends it. Given
sections may overlap or leave gaps; they are code point spans, cut to the text,
and a null or empty list gives no rows. Null texts count as empty; an empty
text has no lines; very long texts are encoded whole. Repeated rows each give
their sections, as do sections of equal bounds, each under its own number; an
empty table gives no rows. Columns may have any name; others than the id go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm import bpe
from plumbline.llm.common import named, slices, texts

FIELDS = ("section", "start", "end", "n_tokens", "n_crossing")
RULES = ("first", "last", "middle")


def line_bounds(text: bytes) -> np.ndarray:
    """Where lines begin, in bytes, and where the text ends."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(text)]])).astype(np.int64)


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [start, end) in bytes, and how many of these reach beyond it; ``sizes``: bytes of the tokens."""
    after = np.cumsum(sizes)
    first = after - sizes
    anchor = {"first": first, "last": after - 1, "middle": (first + after - 1) // 2}[rule]
    low, high = np.searchsorted(anchor, starts), np.searchsorted(anchor, ends)
    inside = np.searchsorted(first, starts), np.searchsorted(after, ends, side="right")
    whole = np.maximum(0, np.minimum(high, inside[1]) - np.maximum(low, inside[0]))
    return np.maximum(0, high - low), np.maximum(0, high - low) - whole


def count(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", sections: str | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each section.

    ``sections``: a column of array<struct<start, end>>, None for lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    content = bpe.shared(df, path)
    bound = lambda s, k: s[k].cast("long").alias(k)
    given = [F.transform(named(sections), lambda s: F.struct(bound(s, "start"), bound(s, "end"))).alias("given")] if sections else []
    docs = df.select(named(id_col).alias("doc_id"), named(text).cast("string").alias("text"), *given)
    schema = StructType([docs.schema["doc_id"]])
    for f in FIELDS:
        schema = schema.add(f, "long")

    def run(batches):
        codec = bpe.codec_of(content())
        held = bpe.WordIds(codec)
        for part in slices(batches, "text", bpe.INDEX_BYTES):
            column, ids = texts(part.column("text")), part.column("doc_id")
            spans = part.column("given").to_pylist() if sections else None
            words = held.words(column)
            for a, b in bpe.pieces(words):
                found, bounds = held.gather(words[a:b])
                sizes = codec.lengths[found]
                rows, of = [], []
                for i in range(a, b):
                    raw = column[i].encode()
                    if spans is None:
                        cuts = line_bounds(raw)
                        starts, ends = cuts[:-1], cuts[1:]
                    else:
                        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # where characters begin
                        at = np.concatenate([at, [len(raw)]])
                        pick = [[min(max(s[k] or 0, 0), len(at) - 1) for s in spans[i] or []] for k in ("start", "end")]
                        starts, ends = (at[np.array(p, np.int64)] for p in pick)
                    n, crossing = attribute(sizes[bounds[i - a] : bounds[i - a + 1]], starts, ends, rule)
                    if raw.isascii():
                        chars = starts, ends
                    else:
                        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        chars = before[starts], before[ends]
                    rows.append(np.stack([np.arange(len(n)), *chars, n, crossing]))
                    of.append(np.full(len(n), i))
                whole = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(of))), *(pa.array(x.astype(np.int64)) for x in whole)], ["doc_id", *FIELDS])

    return docs.mapInArrow(run, schema)
