"""Benchmark decontamination by an FM-index for each training shard (operator 11).

Whole texts are dealt into shards of up to SHARD_BYTES; a longer text is cut
between words and its pieces overlap by one word less than a window has, so
every occurrence lies within a piece. Each shard gets an FM-index of its words.
The windows of the items are searched backwards in it, through the ranks of its
wavelet levels; occurrences are located by sampled suffix positions; the words
they cover are merged into spans of removal, in words and in code points.

Items come in blocks of about BLOCK_BYTES of their text, whatever their number.
For a single block a shard is indexed and searched in one go; for more the
indexes are written once and each block is searched in them. What a task holds
is one shard, its index and one block.

Words are maximal runs of digits, letters a-z and characters beyond ASCII, after
A-Z are lower-cased. A window is
``most`` consecutive words of an item; an item of fewer, but not none, is one.
Null and empty texts have no words, no spans and no items. Repeated rows each get
a row, items of one id are one item, of several texts perhaps; a null item_id is
none's. Occurrences that touch or overlap are one span. An empty table gives no
rows, an empty benchmark no hits. Very long texts and words are read whole. Other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.common import cut, named, raw, slices
from plumbline.llm.fm_index import Bits, FMIndex

#: Words of a window.
MOST = 10
#: Bytes of a shard, with three for each text: it has fewer than 2^21 words and ends of texts then. Bytes of items in a block.
SHARD_BYTES, BLOCK_BYTES = 4_000_000, 2_000_000
#: Occurrences that are located at a time.
AT_ONCE = 1 << 20
#: Bytes of words as they are, A-Z lower-cased; a blank for all others.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
INDEX = "ids array<{}>, rows array<long>, firsts array<long>, counts array<long>, begins array<long>, words binary, n long, levels array<binary>, zeros array<long>, marks binary, samples binary, starts binary, ends binary"
FOUND = "id {}, row long, n_words long, items array<string>, spans array<struct<first: long, last: long, start: long, end: long>>"


def edges(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the code points before each byte; ``folded`` ends with a blank."""
    a = np.frombuffer(folded, np.uint8)
    at = np.flatnonzero(np.diff(a != 32, prepend=False))
    lead = (a & 0xC0) != 0x80
    return at[::2], at[1::2], np.cumsum(lead, dtype=np.int64) - lead


def pieces(text: bytes, most: int, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The pieces of a text: number of the first word, words that the piece before has as well, code points before, folded bytes."""
    folded = text.translate(FOLD)
    begin = seen = first = held = before = 0
    while True:
        end = folded.find(b" ", max(begin + size, seen + size // 2))
        piece = folded[begin : end if end >= 0 else len(folded)]
        yield first, held, before, piece
        if end < 0:
            return
        starts, _, chars = edges(piece + b" ")
        held = min(most - 1, len(starts))
        at = int(starts[len(starts) - held]) if held else len(piece)
        first, before, begin, seen = first + len(starts) - held, before + int(chars[at]), begin + at, end


def index_of(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One shard: (id, row, first, again, before, piece) of its texts, indexed."""
    ids, rows, firsts, again, before, texts = zip(*held, strict=True)
    buffer = b" ".join([*texts, b""])
    offsets = np.cumsum([0, *[len(x) + 1 for x in texts]])
    word_starts, word_ends, chars = edges(buffer)
    at = np.searchsorted(word_starts, offsets)
    counts = np.diff(at)
    ended = np.concatenate([[0], np.cumsum(counts > 0)])  # ends of texts before each
    numbers = defaultdict(count(1).__next__)
    symbols = np.fromiter(map(numbers.__getitem__, buffer.split()), np.int64, len(word_starts))
    places = np.arange(len(symbols)) + np.repeat(ended[:-1], counts)
    n = len(symbols) + int(ended[-1])
    seq, starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
    base = np.repeat(np.array(before) - chars[np.minimum(offsets[:-1], len(buffer) - 1)], counts)
    seq[places], starts[places], ends[places] = symbols, chars[word_starts] + base, chars[word_ends] + base
    begins = at[:-1] + ended[:-1]
    fm = FMIndex.build(seq, begins[counts > 0])
    lists = [ids, rows, firsts, counts - np.array(again), begins, b" ".join(numbers), n, [x.words.tobytes() for x in fm.levels], fm.zeros, fm.marks.words.tobytes(), fm.samples.tobytes(), starts.tobytes(), ends.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(lists, schema, strict=True)], schema=schema)


def indexes(batches: Iterable[pa.RecordBatch], most: int, schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, row, text) to one row for each shard."""
    held, cost = [], 0
    for part in slices(batches, "text"):
        for doc_id, row, text in zip(part.column("id").to_pylist(), part.column("row").to_pylist(), raw(part.column("text")), strict=True):
            for first, again, before, piece in pieces(text, most, size):
                if held and cost + len(piece) + 3 > size:
                    yield index_of(held, schema)
                    held, cost = [], 0
                held.append((doc_id, row, first, again, before, piece))
                cost += len(piece) + 3
    if held:
        yield index_of(held, schema)


def windows(items: list[tuple[str | None, bytes]], symbols: dict[bytes, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of items whose words all have symbols, shorter ones with -1 in front, and the number of each one's item."""
    rows, owners = [], []
    for k, (_, text) in enumerate(items):
        known = np.fromiter((symbols.get(w, -2) for w in text.split()), np.int64)
        if 0 < len(known) < most:
            known = np.concatenate([np.full(most - len(known), -1), known])
        if len(known):
            rows.append(np.lib.stride_tricks.sliding_window_view(known, most))
            owners.append(np.full(len(rows[-1]), k))
    if not rows:
        return np.zeros((0, most), np.int64), np.zeros(0, np.int64)
    every, owner = np.concatenate(rows), np.concatenate(owners)
    whole = (every > -2).all(axis=1)
    return every[whole], owner[whole]


def found_in(shard: dict, items: list[tuple[str | None, bytes]], most: int) -> tuple[dict[int, set], dict[int, list]]:
    """Of the texts of a shard, by their place in it: the numbers of the items that occur, and the spans."""
    symbols = {w: k for k, w in enumerate(shard["words"].split(b" "), 1)} if shard["words"] else {}
    every, owner = windows(items, symbols, most)
    if not len(every) or not shard["n"]:
        return {}, {}
    words = lambda x: np.frombuffer(x, np.uint64)
    fm = FMIndex(shard["n"], [Bits(words(x)) for x in shard["levels"]], shard["zeros"], Bits(words(shard["marks"])), np.frombuffer(shard["samples"], np.int32))
    phrases, which = np.unique(every, axis=0, return_inverse=True)
    which = which.ravel()
    lo, hi = fm.search(phrases)
    size, length, begins = hi - lo, (phrases >= 0).sum(axis=1), np.array(shard["begins"])
    cover, met = np.zeros(shard["n"] + 1, np.int64), [np.zeros(0, np.int64)]
    ends, total = np.cumsum(size), int(size.sum())
    for at in range(0, total, AT_ONCE):
        nth = np.arange(at, min(at + AT_ONCE, total))
        phrase = np.searchsorted(ends, nth, "right")
        places = fm.locate(lo[phrase] + nth - (ends[phrase] - size[phrase]))
        cover += np.bincount(places, minlength=len(cover)) - np.bincount(places + length[phrase], minlength=len(cover))
        doc = np.searchsorted(begins, places, "right") - 1
        met.append(np.unique(doc * len(phrases) + phrase))
    by_phrase = np.argsort(which, kind="stable")
    limits = np.searchsorted(which[by_phrase], np.arange(len(phrases) + 1))
    occurring: dict[int, set] = defaultdict(set)
    for code in np.unique(np.concatenate(met)).tolist():
        doc, phrase = divmod(code, len(phrases))
        occurring[doc].update(owner[by_phrase[limits[phrase] : limits[phrase + 1]]].tolist())
    at = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
    first, last = at[::2], at[1::2]
    doc = np.searchsorted(begins, first, "right") - 1
    shift = np.array(shard["firsts"])[doc] - begins[doc]
    starts, ends_at = np.frombuffer(shard["starts"], np.int32)[first], np.frombuffer(shard["ends"], np.int32)[last - 1]
    spans: dict[int, list] = defaultdict(list)
    for d, *x in np.stack([doc, first + shift, last + shift, starts, ends_at], axis=1).tolist():
        spans[d].append(dict(zip(("first", "last", "start", "end"), x, strict=True)))
    return occurring, spans


def searched(batches: Iterable[pa.RecordBatch], items: list[tuple[str | None, bytes]], most: int, counted: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each text, or piece of one, of the shards in ``batches``. Words are counted for one block only."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard = batch.slice(k, 1).to_pylist()[0]
            occurring, spans = found_in(shard, items, most)
            n = len(shard["rows"])
            named_items = [sorted({items[i][0] for i in occurring.get(d, ())} - {None}) for d in range(n)]
            columns = [shard["ids"], shard["rows"], shard["counts"] if counted else [0] * n, named_items, [spans.get(d, []) for d in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def schemas(id_type: str) -> tuple[StructType, pa.Schema, StructType, pa.Schema]:
    index, found = (StructType.fromDDL(x.format(id_type)) for x in (INDEX, FOUND))
    return index, to_arrow_schema(index), found, to_arrow_schema(found)


def search(df: DataFrame, benchmark: DataFrame, text: str, id_col: str, item_text: str, item_id: str, most: int, size: int, block: int) -> DataFrame:
    """(id, row, n_words, items, spans) of each piece of each text of ``df`` and each block of items."""
    docs = df.select(named(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), named(text).cast("string").alias("text"))
    index, index_arrow, found, found_arrow = schemas(docs.schema["id"].dataType.simpleString())
    items = cut(benchmark.select(named(item_id).cast("string").alias("item"), named(item_text).cast("string").alias("text")).filter("text is not null"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // block))
    sc = df.sparkSession.sparkContext

    def of(b: int):
        held = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        return sc.broadcast([(r.item, r.text.encode().translate(FOLD)) for r in held])

    make = lambda batches: indexes(batches, most, index_arrow, size)
    if blocks == 1:
        given = of(0)
        return docs.mapInArrow(lambda batches: searched(make(batches), given.value, most, True, found_arrow), found)
    made = cut(docs.mapInArrow(make, index))
    look = lambda b, given: made.mapInArrow(lambda batches: searched(batches, given.value, most, not b, found_arrow), found)
    return reduce(DataFrame.unionByName, [look(b, of(b)) for b in range(blocks)])


def merged(found: DataFrame) -> DataFrame:
    """(row, n_hit, spans): the spans of all pieces and blocks of a text, joined where they touch or overlap."""
    order = Window.partitionBy("row").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.selectExpr("row", "inline(spans)").withColumn("new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    islands = apart.withColumn("island", F.sum("new").over(order)).groupBy("row", "island")
    one = islands.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last", "start", "end"))).alias("spans"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", most: int = MOST, size: int = SHARD_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_words, n_hit, items (ids, as strings), spans (first, last: words; start, end: code points)."""
    found = cut(search(df, benchmark, text, id_col, item_text, item_id, most, size, block))
    rows = found.groupBy("row").agg(F.first("id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = rows.join(merged(found), "row", "left")
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", F.coalesce("spans", F.array().cast(FOUND[FOUND.index("array<struct") :])).alias("spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` with its spans (start, end: code points, in order) cut out."""
    text = F.coalesce(text, F.lit(""))
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    tos = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.zip_with(froms, tos, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
