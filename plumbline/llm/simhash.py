"""SimHash near-duplicates by deletion-variant signatures (operator 4).

A document's fingerprint has a bit for each of the 64 bits of its shingles'
hashes, set where over half the hashes have it set. Fingerprints link at two or
fewer differing bits. Cut into two halves, one half of a linked pair differs by
at most one bit, so the halves share a variant with one bit left out. Each
distinct half is indexed under its 32 variants; an equality join finds the
halves beside it, and the fingerprints that have them are verified on all 64
bits.

Halves with many fingerprints aren't paired: the other halves of these are
indexed without two of their bits instead (without one, where the halves differ
in one). At most four fingerprints share such a key and all of them link, so
this exact way stays in proportion to their number, and no link is lost. Copies
of one fingerprint are one row throughout. Components come from alternating
large-star and small-star rounds until all trees are flat, each written to the
shared folder; nothing is gathered on the driver but a count of the links. Joins
on a node read two written tables, so that Spark splits the partition of a node
that many link to. Halves have 32 bits: they select well up to some 10^10
distinct fingerprints.

Fingerprints of two differing bits find texts that are all but equal. For a
similarity of word shingles, ``minhash`` takes these links first and completes
them.

Null and empty texts and texts without words have fingerprint zero, linked like
any other. A component is named by its smallest doc_id; null ids are passed
over, and a component of null ids has a null name. Repeated rows each get a
row; rows that share a doc_id are one document and share its component. Ties of a
bit, half the hashes with it set, leave it unset. A text of any length is read
whole, a slice of the batch of its own. An empty table gives no rows. Other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, cut, free, named, raw, tables

#: Words of a shingle, seed of its hash.
WORDS, SEED = 3, 42
#: Fingerprints that are paired with each other; larger groups go the exact linear way.
MOST_PAIRED = 256
#: Halves whose variants a task makes, about.
PER_TASK = 20_000
#: Links of a task in the rounds for components, about.
EDGES_PER_TASK = 500_000
#: The bits of a half.
HALF = 0xFFFFFFFF


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit majority of unsigned hashes, as a signed number."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fingerprints of whole texts, as signed 64-bit numbers."""

    def make():
        digest, join = xxhash.xxh64_intdigest, b" ".join

        def work(column):
            out = []
            for text in raw(column):
                found = text.lower().split()  # of bytes: A-Z, and the six blanks
                if not found:
                    out.append(0)
                    continue
                shingles = map(join, zip(*[found[i:] for i in range(words)], strict=False)) if len(found) >= words else [join(found)]
                n = max(1, len(found) - words + 1)
                out.append(fingerprint_of(np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)))
            return [pa.array(out, pa.int64())]

        return work

    return add_columns(df.select(named(id_col).alias("doc_id"), named(text).alias("text")), "text", make, "fp long", ["doc_id"])


def halves(fp: Column) -> Column:
    """Both halves of a fingerprint, the side in bit 32."""
    return F.array(fp.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32)))


def other(fp: Column, half: Column) -> Column:
    """What stands beside ``half`` in a fingerprint."""
    return F.when(half <= HALF, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(HALF)))


def near(a: Column, b: Column, most: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def beside(groups: DataFrame) -> DataFrame:
    """(key, low, high): the distinct halves that differ in one bit, from an equality join of one-wildcard variants.

    A key is a half without one of its bits, with the number of the bit from bit 33 on.
    Two halves at most have it, so the join is an aggregation that notes which of them are there.
    """
    tasks = groups.count() // PER_TASK + 1
    variants = groups.select("half").repartition(tasks, "half").select("half", F.explode(F.array(*map(F.lit, range(32)))).alias("bit"))
    seen = variants.selectExpr("(half & ~shiftleft(1L, bit)) | shiftleft(cast(bit as bigint), 33) as key", "cast(1 + (shiftright(half, bit) & 1) as tinyint) as seen")
    both = seen.groupBy("key").agg(F.bit_or("seen").alias("seen")).filter("seen = 3")
    low = f"(key & {(1 << 33) - 1})"
    return both.selectExpr("key", f"{low} as low", f"{low} | shiftleft(1L, cast(shiftright(key, 33) as int)) as high")


def crowded(rows: DataFrame, out: int) -> DataFrame:
    """Links (a, b) within groups of any size, in proportion to it; ``rows``: (group, half, fp).

    The other half is indexed without ``out`` of its bits; four fingerprints at
    most share such a key, and all of them link.
    """
    masks = F.array(*[F.lit(sum(1 << i for i in bits)) for bits in combinations(range(32), out)])
    each = rows.select("group", "fp", other(F.col("fp"), F.col("half")).alias("other"), F.explode(masks).alias("mask"))
    keys = each.groupBy("group", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))
    return keys.filter(F.size("fps") > 1).select("a", F.explode("fps").alias("b"))


def links(distinct: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Linked pairs (a, b), a < b, of the distinct fingerprints ``fp``: enough for all components.

    A linked pair shares a half, or has halves that differ in one bit and others
    that differ in one at most. Single fingerprints of two such halves, and pairs
    that share a half, come from the counts; only fuller groups are joined.
    """
    members = distinct.select("fp", F.explode(halves(F.col("fp"))).alias("half"))
    groups = cut(members.groupBy("half").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")))
    low, high = (groups.select(F.col("half").alias(x), F.col("n").alias(f"n_{x}"), F.col("a").alias(f"a_{x}")) for x in ("low", "high"))
    met = cut(beside(groups).join(low, "low").join(high, "high"))
    found = [groups.filter("n = 2").select("a", "b"), met.filter("n_low = 1 and n_high = 1").select(F.col("a_low").alias("a"), F.col("a_high").alias("b"))]
    fuller, several = groups.filter("n > 2"), met.filter("n_low + n_high > 2")
    if not fuller.isEmpty():
        own = cut(members.join(fuller.select("half", "n"), "half"))
        a, b = (own.filter(F.col("n") <= most_paired).select("half", F.col("fp").alias(x)) for x in "ab")
        found.append(a.join(b, "half").filter("a < b").select("a", "b"))
        found.append(crowded(own.filter(F.col("n") > most_paired).withColumn("group", F.col("half")), 2))
    if not several.isEmpty():
        sides = several.select("key", (F.col("n_low") + F.col("n_high")).alias("n"), F.explode(F.array("low", "high")).alias("half"), "low")
        own = cut(sides.join(members, "half").withColumnRenamed("key", "group"))
        few = own.filter(F.col("n") <= most_paired)
        a, b = few.filter("half = low").select("group", F.col("fp").alias("a")), few.filter("half <> low").select("group", F.col("fp").alias("b"))
        found.append(a.join(b, "group").select("a", "b"))
        found.append(crowded(own.filter(F.col("n") > most_paired), 1))
    pairs = reduce(DataFrame.unionByName, found).filter((F.col("a") != F.col("b")) & near(F.col("a"), F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def flat(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b) has one ``b``, which is no ``a`` itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); the root is the smallest node that is reachable."""
    with tables(pairs.sparkSession) as written:
        edges = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
        tasks = edges.count() // EDGES_PER_TASK + 1  # rounds don't add edges, and most make far fewer

        def star(edges: DataFrame) -> DataFrame:
            """Edges from each node's neighbours to the smallest of them and itself."""
            least = written(edges.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")).coalesce(tasks))
            return edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"), F.col("a").alias("via"))

        while not flat(edges):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = written(star(both).filter("a > via and a > b").select("a", "b").distinct().coalesce(tasks))
            least = written(large.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks))
            small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
            edges = written(small.filter("a > b").distinct().coalesce(tasks))
        return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id isn't one of ``gone`` (doc_id); rows with a null id stay."""
    drop = free(df, "drop")
    return df.join(cut(gone.select(F.col("doc_id").alias(drop)).distinct()), named(id_col) == F.col(drop), "left_anti")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", most_paired: int = MOST_PAIRED) -> DataFrame:
    """One row for each row of ``df``: doc_id, fp, component_id."""
    docs = cut(fingerprints(df, text, id_col))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = cut(links(distinct, most_paired))
    if pairs.isEmpty():
        called = distinct.select("fp", F.col("least").alias("component_id"))
    else:
        roots = components(pairs)
        labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        labelled = cut(labelled)
        names = cut(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
        called = labelled.join(names, "root").select("fp", "component_id")
    return docs.join(cut(called), "fp").select("doc_id", "fp", "component_id")


def deduplicated(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose document gives its component the name; rows with a null id stay."""
    return without(df, id_col, near_duplicates(df, text, id_col).filter("doc_id <> component_id"))
