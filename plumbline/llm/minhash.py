"""Operator 4 at a similarity of word shingles: fingerprint links, completed by MinHash bands and verified.

Texts are sets of shingles of WORDS words, as 64-bit hashes. They link at a
Jaccard similarity of SIMILAR percent or more, which every link is verified for.
Candidates come first from the deletion-variant signatures of ``simhash``. Alone
these give wrong results here: fingerprints of texts at 0.8 differ in ten bits of
64, and for up to 17 bits, which nearly all such pairs keep to, the segments
would have seven bits, which nearly all texts share. So candidates also share one
of BANDS bands of ROWS minima. A pair at 0.8 has none with a probability of
(1 - 0.8 ** 4) ** 32 = 5e-8.

All that is needed are components, so texts that share a band aren't all paired.
PIVOTS times, each is verified with one text of its band. Then what is in
different components yet is compared as far as it can be similar at all: directly
in bands of up to FEW texts, whose number is in proportion to the texts; beyond,
by a prefix filter, which is exact. There each text's rarest shingles are
indexed, as many as a similar text can't lack, and two texts meet by an equality
join on one of them and on their sizes, if its places among the rarest leave room
for enough shingles in common. Of the component with most texts at a shingle
none are compared with each other. No pair is passed over but those in one
component.

Texts of fewer words are one shingle. Null and empty texts and texts without
words have the empty set, all in one component. Sets count equal if their 64-bit
hashes are. Components are named, and rows with null ids or shared ids, ties, very
long texts, empty tables and names of other columns handled, as in ``simhash``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import add_columns, cut, named, raw
from plumbline.llm.simhash import components, fingerprint_of, without

#: Words of a shingle, percent of similarity from which texts link.
WORDS, SIMILAR = 5, 80
#: Bands of a text, minima of a band, seed of their hashes.
BANDS, ROWS, SEED = 32, 4, 42
#: Rounds with a text of each band, texts of a band that are compared directly.
PIVOTS, FEW = 3, 16
#: Texts meet by sizes in steps of this factor.
STEP = 1.02


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = text.lower().split()  # of bytes: A-Z, and the six blanks
    if not found:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    each = map(join, zip(*[found[i:] for i in range(words)], strict=False)) if len(found) >= words else [join(found)]
    return np.unique(np.fromiter((digest(s, SEED) for s in each), np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of the bands of sets that aren't empty, a row for each set."""
    rng = np.random.default_rng(SEED)
    salts, factors = rng.integers(0, 2**64, (2, BANDS, ROWS), np.uint64, endpoint=False)
    factors |= np.uint64(1)
    every, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b, np.uint64)
        for r in range(ROWS):
            mixed = (every ^ salts[b, r]) * factors[b, r]
            low = np.minimum.reduceat(mixed, starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def hash_of(shingle_set: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingle_set.tobytes(), SEED) if len(shingle_set) else 0


def longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, fp, size, sim, keys): of a whole text the hash of its set, the set's size and fingerprint, and its bands."""

    def make():
        def work(column):
            sets = [shingles(x, words) for x in raw(column)]
            full = [s for s in sets if len(s)]
            keys = iter(bands(full).view(np.int64) if full else ())
            none = np.zeros(0, np.int64)
            return [
                longs([hash_of(s) for s in sets]),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint_of(s) if len(s) else 0 for s in sets], pa.int64()),
                pa.array([next(keys) if len(s) else none for s in sets], pa.list_(pa.int64())),
            ]

        return work

    rows = df.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    return add_columns(rows, "text", make, "fp long, size long, sim long, keys array<long>", ["doc_id"])


def sets_of(df: DataFrame, docs: DataFrame, wanted: DataFrame, text: str, id_col: str, words: int) -> DataFrame:
    """(fp, shingles) of the ``wanted`` fp, from the texts of one document each."""

    def make():
        def work(column):
            sets = [shingles(x, words) for x in raw(column)]
            return [longs([hash_of(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

        return work

    one = docs.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("wanted_id"))
    rows = df.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    chosen = rows.join(cut(one.select("wanted_id").distinct()), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    made = add_columns(chosen, "text", make, "fp long, shingles array<long>", [])
    return cut(made.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles")))


def alike(x: Column, y: Column, similar: int) -> Column:
    """Whether sets of two sizes can be similar."""
    return 100 * F.least(x, y) >= similar * F.greatest(x, y)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Of pairs (a, b) of ``fp`` those whose sets are similar."""
    a, b = (sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= similar * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``fp`` whose fingerprints link: one text of each fingerprint, and the others of it with that one."""
    full = distinct.filter("size > 0")
    ones = cut(full.groupBy("sim").agg(F.min("fp").alias("one"), F.count("*").alias("n")))
    pairs = simhash.links(ones.select(F.col("sim").alias("fp")))
    left, right = (ones.select(F.col("sim").alias(x), F.col("one").alias(f"one_{x}")) for x in "ab")
    between = pairs.join(left, "a").join(right, "b").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))
    within = full.join(ones.filter("n > 1"), "sim").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    return between.unionByName(within)


def rooted(own: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``own`` with the ``root`` of each text; that of a text without links is its own."""
    return own.withColumn("root", F.col("fp")) if roots is None else own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def pivot_pairs(parts: DataFrame, turn: int, similar: int) -> DataFrame:
    """Pairs (a, b) of each text with one text of its band, drawn by a hash of both, unless they are in one component."""
    pivot = parts.groupBy("key").agg(F.min_by(F.struct("fp", "size", "root"), F.struct(F.xxhash64("fp", "key", F.lit(turn)), "fp")).alias("p"))
    met = parts.join(pivot, "key").filter((F.col("root") != F.col("p.root")) & alike(F.col("size"), F.col("p.size"), similar))
    return met.select(F.col("fp").alias("a"), F.col("p.fp").alias("b"))


def level(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(STEP))).cast("int")


def prefix_pairs(texts: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of ``texts`` (fp, root, size) in different components that the prefix filter leaves; no similar pair is lost."""
    each = texts.join(sets, "fp").select("fp", "root", "size", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("shared"))
    noted = each.join(counts, "shingle").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle", "shared"))).alias("by_rarity"))
    size, at = F.col("size"), F.col("at")
    most = size - F.ceil(size * similar / 100) + 1
    places = noted.select("fp", "root", "size", F.posexplode(F.slice("by_rarity", F.lit(1), most.cast("int"))).alias("at", "x"))
    places = cut(places.filter("x.shared").select("fp", "root", "size", "at", F.col("x.shingle").alias("shingle")))
    # the smaller text of a pair at ``index``, the larger one, which says what sizes it can meet, at ``probe``
    index = places.filter(size - at >= F.ceil(size * 2 * similar / (100 + similar))).withColumn("level", level(size))
    least = F.ceil(size * similar / 100)
    greatest = F.least(size, F.floor((size - at) * (100 + similar) / similar - size))
    probe = places.withColumn("least", least).withColumn("greatest", greatest).filter("least <= greatest")
    probe = probe.withColumn("level", F.explode(F.sequence(level(F.col("least")), level(F.col("greatest")))))
    shares = index.groupBy("shingle", "level", "root").agg(F.count("*").alias("n"))
    major = cut(shares.groupBy("shingle", "level").agg(F.max(F.struct("n", "root"))["root"].alias("major")))
    index, probe = (cut(x.join(major, ["shingle", "level"]).withColumn("minor", F.col("root") != F.col("major")).drop("major")) for x in (index, probe))
    a = probe.select("shingle", "level", F.col("fp").alias("a"), F.col("root").alias("r_a"), "least", "greatest", F.col("at").alias("at_a"), F.col("size").alias("n_a"), F.col("minor").alias("m_a"))
    b = index.select("shingle", "level", F.col("fp").alias("b"), F.col("root").alias("r_b"), F.col("at").alias("at_b"), F.col("size").alias("n_b"), F.col("minor").alias("m_b"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    room = (100 + similar) * F.least(n_a - F.col("at_a"), n_b - F.col("at_b")) >= similar * (n_a + n_b)
    fits = (F.col("r_a") != F.col("r_b")) & (n_b >= F.col("least")) & (n_b <= F.col("greatest")) & room
    met = [x.join(y, ["shingle", "level"]).filter(fits).select("a", "b") for x, y in ((a.filter("m_a"), b), (a.filter("not m_a"), b.filter("m_b")))]
    return reduce(DataFrame.unionByName, met)


def pairs_left(parts: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) in one band and different components that can be similar."""
    apart = parts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    left = cut(parts.join(apart.select("key"), "key", "left_semi"))
    a, b = (left.filter(F.col("n") <= FEW).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", "size")]) for x in "ab")
    direct = a.join(b, "key").filter((F.col("root_a") < F.col("root_b")) & alike(F.col("size_a"), F.col("size_b"), similar)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    many = cut(left.filter(F.col("n") > FEW).select("fp", "root", "size").distinct())
    return direct if many.isEmpty() else direct.unionByName(prefix_pairs(many, sets, similar))


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row for each row of ``df``: doc_id, fp, component_id."""
    docs = cut(sketches(df, text, id_col, words))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("keys").alias("keys")))
    members = distinct.select("fp", "size", F.explode("keys").alias("key"))
    own = cut(members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))
    by_print = cut(ordered(fingerprint_pairs(distinct)))
    wanted = cut(own.select("fp").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("fp"))).distinct())
    sets = sets_of(df, docs, wanted, text, id_col, words)
    tested, found, roots = None, None, None
    for turn in range(PIVOTS + 1):
        parts = rooted(own, roots)
        pairs = pairs_left(parts, sets, similar) if turn == PIVOTS else pivot_pairs(parts, turn, similar)
        pairs = ordered(pairs if tested is not None else pairs.unionByName(by_print))
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        more = cut(verified(pairs, sets, similar))
        found, tested = (more, pairs) if tested is None else (found.unionByName(more), tested.unionByName(pairs))
        roots = components(found).select(F.col("node").alias("fp"), "root")
    labelled = cut(rooted(distinct.select("fp", "least"), roots))
    names = cut(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    called = cut(labelled.join(names, "root").select("fp", "component_id"))
    return docs.select("doc_id", "fp").join(called, "fp").select("doc_id", "fp", "component_id")


def deduplicated(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose document gives its component the name; rows with a null id stay."""
    return without(df, id_col, near_duplicates(df, text, id_col).filter("doc_id <> component_id"))
