"""Byte-level BPE encoding and decoding by a pair occurrence index (operator 1).

A task splits its texts into pre-tokens, numbers the distinct ones and lays
their bytes out in one array of symbols. An index maps each mergeable pair to
all its positions there. Ranks that have positions wait in a heap; the lowest
is applied to all its positions at once, and the pairs that arise beside the
merged symbols go into the lists of their own ranks. Texts then gather the ids
of their pre-tokens.

The vocabulary file is read on the driver and broadcast, a large one sent along
as a file, so executors need no copy of it. Null texts count as empty and have no
ids. Of pairs of one rank in a run of one symbol, the first merges. Repeated rows
are encoded each; other columns pass through; a column named like a result is
replaced. Any length of text works: a text is never cut, and the work grows in
proportion to its bytes. Ids to decode that are null or not in the vocabulary
have no text. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from plumbline.llm.common import add_columns, named, texts

#: How the public vocabulary splits text before its merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Above this code point the Unicode tables of the two regex engines differ in places.
SAME_TABLES_BELOW = 0x500
#: Bytes of text whose pre-tokens share one index, and bytes that leave at a time.
INDEX_BYTES, PIECE_WORDS = 2_000_000, 100_000
#: Places whose pairs are looked up at a time when an index is made.
NOTED = 200_000
#: Pre-tokens that a task keeps from slice to slice, and their characters, before it starts anew.
MOST_WORDS, MOST_CHARACTERS = 300_000, 8_000_000
#: A vocabulary file beyond this goes to executors as a file of the job instead of a broadcast.
MOST_VOCAB_BYTES = 64_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Vocabulary, merges and special tokens of a byte-level BPE file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, of = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.beyond = regex.compile(f"[^\\x00-{chr(SAME_TABLES_BELOW - 1)}]")
        self.content, self.library = content, None
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in of.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.first = [vocab[a] for a, _ in merges]
        self.second = [vocab[b] for _, b in merges]
        self.merged = [vocab[a + b] for a, b in merges]
        keys = np.array(self.first, np.int64) << 32 | np.array(self.second, np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def pre_tokens(self, text: str) -> list[str]:
        """Special tokens stand alone; the rest is split as the vocabulary asks."""
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1 and not self.beyond.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif not self.beyond.search(part):
                out += self.split.findall(part)
            else:  # rare scripts: the splitter of the public library, for its Unicode tables
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_str(self.content.decode()).pre_tokenizer
                out += [part[s:e] for _, (s, e) in self.library.pre_tokenize_str(part)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: how many each has, and all of them in a row."""
        spelled = [b"" if w in self.special else w.encode() for w in words]
        n = np.array([len(w) for w in spelled], np.int64)
        ends = np.cumsum(n + 1)
        symbol = np.full(int(ends[-1]) + 1 if len(n) else 1, -1, np.int32)  # -1 stands between words
        inside = np.ones(len(symbol), bool)
        inside[ends - 1] = False
        inside[-1] = False
        symbol[inside] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Put positions into the lists of the ranks of the pairs that stand there."""
            keys = left.astype(np.int64) << 32 | right
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[found] == keys).nonzero()[0]
            if not len(hit):
                return
            ranks, at = self.rank_of[found[hit]], at[hit]
            if len(hit) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, at = ranks[order], at[order]
                bounds = (ranks[1:] != ranks[:-1]).nonzero()[0] + 1
                groups = zip(ranks[np.concatenate([[0], bounds])].tolist(), np.split(at, bounds), strict=True)
            else:
                groups = [(int(ranks[0]), at)]
            for rank, positions in groups:
                if rank in index:
                    index[rank].append(positions)
                else:
                    index[rank] = [positions]
                    heapq.heappush(active, rank)

        del inside
        for low in range(0, len(symbol) - 1, NOTED):
            part = symbol[low : low + NOTED + 1]
            here = ((part[:-1] >= 0) & (part[1:] >= 0)).nonzero()[0].astype(np.int32)
            note(here + np.int32(low), part[here], part[here + 1])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.first[rank], self.second[rank], self.merged[rank]
            at = at[symbol[at] == a]
            mate = after[at]
            still = symbol[mate] == b
            at, mate = at[still], mate[still]
            if a == b and len(at) > 1:  # in a run of one symbol, pairs start at every second place
                at = np.unique(at)
                mate = after[at]
                opens = np.concatenate([[True], mate[:-1] != at[1:]])
                place = np.arange(len(at))
                odd = (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2
                at, mate = at[odd == 0], mate[odd == 0]
            if not len(at):
                continue
            symbol[at], symbol[mate] = new, -2
            follow = after[mate]
            after[at] = follow
            before[follow] = at
            lead = before[at]
            left, right = symbol[lead], symbol[follow]
            l_ok, r_ok = left >= 0, right >= 0
            note(np.concatenate([lead[l_ok], at[r_ok]]), np.concatenate([left[l_ok], np.full(int(r_ok.sum()), new, np.int32)]), np.concatenate([np.full(int(l_ok.sum()), new, np.int32), right[r_ok]]))
        del after, before
        alive = symbol >= 0
        total = np.cumsum(alive, dtype=np.int32)  # places between words count nothing: a word ends where the next begins
        counts = np.diff(total[ends - 1], prepend=0).astype(np.int64) if len(n) else n
        ids = symbol[alive]
        if special := [i for i, w in enumerate(words) if w in self.special]:
            at = np.cumsum(counts)[special]
            ids = np.insert(ids, at, [self.special[words[i]] for i in special])
            counts[special] = 1
        return counts, ids

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id lists; list i is ids[bounds[i]:bounds[i + 1]]. Bytes that aren't UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        spelled = self.spelling[spread(self.starts[ids], size)].tobytes()
        cuts = ends[bounds].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of many ranges, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """Numbers for pre-tokens, and their ids, kept within a task."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.counts = self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def words(self, column: list[str]) -> list[array]:
        """Numbers of the pre-tokens of each text; new ones are merged together."""
        if len(self.number) > MOST_WORDS or self.characters > MOST_CHARACTERS:
            self.clear()
        number, known, out = self.number, len(self.number), []
        for text in column:
            words = self.codec.pre_tokens(text)
            for w in set(words).difference(number):
                number[w] = len(number)
                self.characters += len(w)
            out.append(array("i", map(number.__getitem__, words)))
        if len(number) > known:
            counts, ids = self.codec.merge(list(number)[known:])
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
            self.starts = np.cumsum(self.counts) - self.counts
        return out

    def gather(self, words: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and their bounds."""
        flat = np.frombuffer(b"".join(words), np.int32)
        size = self.counts[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[spread(self.starts[flat], size)], ends[np.concatenate([[0], np.cumsum([len(w) for w in words])])]


def pieces(words: list[array]):
    """Ranges of texts that hold about PIECE_WORDS pre-tokens."""
    start, held = 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > PIECE_WORDS:
            yield start, i
            start, held = i, 0
        held += len(w)
    if start < len(words):
        yield start, len(words)


@lru_cache(2)
def codec_of(content: bytes) -> Codec:
    return Codec(content)


def shared(df: DataFrame, path: str) -> Callable[[], bytes]:
    """Gives executors the content of the vocabulary file at ``path``, which the driver reads."""
    sc = df.sparkSession.sparkContext
    if os.path.getsize(path) > MOST_VOCAB_BYTES:
        sc.addFile(path)
        name = os.path.basename(path)
        return lambda: open(SparkFiles.get(name), "rb").read()  # noqa: SIM115
    with open(path, "rb") as f:
        content = sc.broadcast(f.read())
    return lambda: content.value


def lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``, the token ids of ``text``; with ``decoded``, also the text that they decode to."""
    content = shared(df, path)

    def make():
        codec = codec_of(content())
        held = WordIds(codec)

        def work(column):
            words = held.words(texts(column))
            for a, b in pieces(words):
                found, bounds = held.gather(words[a:b])
                yield a, b - a, [lists(found, bounds), *([pa.array(codec.decode(found, bounds), pa.string())] if decoded else [])]

        return work

    return add_columns(df, text, make, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), keep, INDEX_BYTES)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the text of the id list in ``ids``; null and empty lists give an empty text."""
    from pyspark.sql.types import StructField, StructType

    content = shared(df, path)
    own = [c for c in df.columns if c.lower() != decoded.lower()]
    passed = [f"c{i}" for i in range(len(own))]
    schema = StructType([StructField(p, df.schema[c].dataType, True) for p, c in zip(passed, own, strict=True)]).add("text", "string")

    def run(batches):
        codec = codec_of(content())
        known = len(codec.lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                found = [[i for i in x or [] if i is not None and 0 <= i < known] for x in piece.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                flat = np.array([i for x in found for i in x], np.int64)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in passed), pa.array(codec.decode(flat, bounds), pa.string())], schema.names)

    given = [named(c).alias(p) for p, c in zip(passed, own, strict=True)]
    return df.select(*given, named(ids).alias("ids")).mapInArrow(run, schema).toDF(*own, decoded)
