"""Merkle manifest of a dataset with proofs looked up by coordinates (operator 13).

Each row is a leaf, the SHA-256 of its columns (``-`` if null, else UTF-8 bytes,
a colon and the value). The leaves of a partition of the dataset, in the order
of their ids, make a tree: ``fanout`` consecutive nodes at a time give a node
of the level above, the SHA-256 of their digests as hex text, until one is left,
the subroot. Subroots, in the order of their partition's name, make the top tree.

A node's coordinates are its tree, level and index. All nodes are written as a
table. A leaf's siblings follow from its index and its tree's size alone: every
leaf lists their coordinates, which are joined with the table, ordered,
concatenated and folded. Nodes high up are siblings of many leaves, so they stand
in the table once for each block of ``BLOCK`` leaves that asks for them, with the
block in the key: no key is asked for more than BLOCK times, however large a
partition is. Trees are built BLOCK leaves at a time in one row, so a table of n
rows takes log n / log BLOCK rounds. Leaves are numbered range by range.

Null names are a partition of their own, before all others. Null ids stand
first; rows of one id stand in the order of their leaves, so repeated rows each
get a row. Empty texts differ from null ones. Very long texts are hashed whole. An
empty table gives no rows. Columns are asked for by name, other columns are never
looked at. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, named, sha256, small

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tree that are built in one row: fanout ** LEVELS leaves.
FANOUT, LEVELS = 2, 10
#: Levels of the top tree count from here.
TOP = 1000


def part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return sha256(F.concat(*[part(c) for c in columns]))


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``index``, from 0 on within ``keys``, and ``n``, the rows of a key: ranges are counted, then numbered apart."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut(df.repartitionByRange(int(n), *[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("range", F.spark_partition_id()))
    of_key = Window.partitionBy(*keys)
    counts = ranged.groupBy(*keys, "range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("range").alias("range_"), before.alias("start"), F.sum("rows").over(of_key).alias("n"))
    same = F.col("range") == F.col("range_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    within = ranged.withColumn("index", F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*order)).cast("long") - 1)
    return within.join(starts, same).withColumn("index", F.col("index") + F.col("start")).drop("range", "range_", "start", *[f"{k}_" for k in keys])


def power(base: int, exponent: Column) -> Column:
    return F.pow(F.lit(float(base)), exponent).cast("long")


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def size_at(n: Column, level: Column, fanout: int) -> Column:
    """Nodes at ``level`` of a tree of ``n`` leaves."""
    return div(n + power(fanout, level) - 1, power(fanout, level))


def depth(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: counted, not by logarithms, which round."""
    levels = F.sequence(F.lit(0), F.lit(int(62 / math.log2(fanout))))
    return F.size(F.filter(levels, lambda k: power(fanout, k) < n))


def above(nodes: Column, fanout: int) -> Column:
    """The digests one level above an array of digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "").cast("binary"), 256))


def noted(nodes: Column, level: int, first: Column) -> Column:
    """(level, index, hash) of an array of digests, of which the first has the index ``first``."""
    return F.transform(nodes, lambda h, i: F.struct(F.lit(level).alias("level"), (first + i).alias("index"), h.alias("hash")))


def trees(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, n, level, index, hash) of all nodes; ``leaves``: (tree, n, index, hash)."""
    block, now, done, base = fanout**levels, leaves.select("tree", "n", "index", "hash"), [], 0
    most = now.agg(F.max("n").alias("n")).select(depth(F.col("n"), fanout).alias("deep")).first().deep
    while True:
        grouped = now.groupBy("tree", "n", div(F.col("index"), block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("own"))
        stacked = grouped.select("tree", "n", "block", F.col("own.hash").alias("l0"))
        for k in range(1, levels + 1):
            # a tree ends at its subroot; in larger ones a lone node goes on
            more = above(F.col(f"l{k - 1}"), fanout)
            stacked = stacked.withColumn(f"l{k}", F.when(depth(F.col("n"), fanout) >= base + k, more).otherwise(F.array().cast("array<string>")))
        stacked = cut(stacked)
        last = most <= base + levels
        # the last level is the next round's first
        each = [noted(F.col(f"l{k}"), base + k, F.col("block") * fanout ** (levels - k)) for k in range(levels + last)]
        done.append(stacked.select("tree", "n", F.inline(F.concat(*each))))
        if last:
            return reduce(DataFrame.unionByName, done)
        now = stacked.select("tree", "n", F.col("block").alias("index"), F.try_element_at(f"l{levels}", F.lit(1)).alias("hash")).filter("hash is not null")
        base += levels


def siblings(index: Column, n: Column, level: Column, fanout: int) -> Column:
    """Indexes of the other nodes of the run that holds the ancestor of leaf ``index`` at ``level``."""
    own = div(index, power(fanout, level))
    first = div(own, fanout) * fanout
    last = F.least(first + fanout - 1, size_at(n, level, fanout) - 1)
    return F.filter(F.sequence(first, last), lambda i: i != own)


def coordinates(place: str, n: str, base: int, fanout: int) -> Column:
    """(level, index) of all siblings of a leaf."""
    levels = F.sequence(F.lit(0), depth(F.col(n), fanout) - 1)
    each = F.transform(levels, lambda k: F.transform(siblings(F.col(place), F.col(n), k, fanout), lambda i: F.struct((k + base).alias("level"), i.alias("index"))))
    return F.when(F.col(n) > 1, F.flatten(each)).otherwise(F.array().cast("array<struct<level:int,index:bigint>>"))


def folded(leaf: Column, proof: Column, place: Column, n: Column, base: int, fanout: int) -> Column:
    """The root that ``leaf`` and its siblings (level, index, hash) give."""

    def up(acc, k):
        own = div(place, power(fanout, k))
        of = lambda left: F.array_join(F.transform(F.filter(proof, lambda s: (s["level"] == k + base) & ((s["index"] < own) if left else (s["index"] > own))), lambda s: s["hash"]), "")
        return F.sha2(F.concat(of(True), acc, of(False)).cast("binary"), 256)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), depth(n, fanout) - 1), leaf, up)).otherwise(leaf)


def manifest(df: DataFrame, key: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, tampered: dict[str, Column] | None = None, when: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``df``: doc_id, leaf, subroot, root, proof (level, index, hash), folded_root, verified.

    ``tampered``: values that replace columns where ``when`` holds; the leaf
    that is verified is made from them then. Levels from TOP on are of the top tree.
    """
    block = fanout**levels
    value = {c: named(c) for c in columns}
    now = leaf_of([value[c] for c in columns])
    other = F.when(F.coalesce(when, F.lit(False)), leaf_of([(tampered or {}).get(c, value[c]) for c in columns])) if when is not None else F.lit(None)
    rows = df.select(named(id_col).alias("doc_id"), named(key).cast("string").alias("key"), now.alias("hash"), other.cast("string").alias("seen"))
    leaves = numbered(rows, ["key"], [F.col("doc_id").asc_nulls_first(), F.col("hash")])
    # a tree is a number from here on, in the order of names
    called = cut(numbered(leaves.filter("index = 0").select("key"), [], [F.col("key").asc_nulls_first()]).select(F.col("key").alias("name"), F.col("index").alias("tree"), F.col("n").alias("trees")))
    leaves = leaves.join(small(called), F.col("key").eqNullSafe(F.col("name"))).select("tree", "trees", "n", "index", "doc_id", "hash", F.coalesce("seen", "hash").alias("seen"))
    leaves = cut(leaves)
    nodes = cut(trees(leaves, fanout, levels))
    subroots = cut(nodes.filter(F.col("level") == depth(F.col("n"), fanout)).join(small(called), "tree").select("tree", "trees", "n", "hash"))
    tops = cut(trees(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("index"), "hash"), fanout, levels))
    root = tops.filter(F.col("level") == depth(F.col("n"), fanout)).select(F.col("hash").alias("root"))
    # what each block of leaves asks for: (tree, block, level, index) with the node's digest
    low = nodes.filter(F.col("level") < levels).withColumn("block", div(F.col("index") * power(fanout, F.col("level")), block))
    high = nodes.filter(F.col("level") >= levels).withColumn("wide", power(fanout, F.col("level") + 1 - levels)).withColumn("from", div(F.col("index"), fanout) * F.col("wide"))
    blocks = div(F.col("n") - 1, block)
    high = high.filter(F.col("from") <= blocks).withColumn("block", F.explode(F.sequence("from", F.least(F.col("from") + F.col("wide") - 1, blocks))))
    asked = subroots.select("tree", "n", "trees").withColumn("c", F.explode(coordinates("tree", "trees", TOP, fanout))).select("tree", "n", F.col("c.level").alias("level"), F.col("c.index").alias("index"))
    joined = asked.join(tops.select((F.col("level") + TOP).alias("level"), "index", "hash"), ["level", "index"])
    upper = joined.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    table = reduce(DataFrame.unionByName, [x.select("tree", "block", F.col("level").cast("int").alias("level"), "index", "hash") for x in (low, high, upper)])
    wanted = leaves.select("tree", "n", "trees", F.col("index").alias("place")).withColumn("block", div(F.col("place"), block))
    wanted = wanted.withColumn("c", F.explode(F.concat(coordinates("place", "n", 0, fanout), coordinates("tree", "trees", TOP, fanout))))
    found = wanted.select("tree", "block", "place", F.col("c.level").alias("level"), F.col("c.index").alias("index")).join(table, ["tree", "block", "level", "index"])
    proofs = found.groupBy("tree", "place").agg(F.array_sort(F.collect_list(F.struct("level", "index", "hash"))).alias("proof"))
    whole = leaves.join(proofs.withColumnRenamed("place", "index"), ["tree", "index"], "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<struct<level:int,index:bigint,hash:string>>")))
    whole = whole.join(small(subroots.select("tree", F.col("hash").alias("subroot"))), "tree").join(F.broadcast(root), F.lit(True))
    again = folded(F.col("seen"), F.col("proof"), F.col("index"), F.col("n"), 0, fanout)
    whole = whole.withColumn("again", again).withColumn("folded_root", folded(F.col("again"), F.col("proof"), F.col("tree"), F.col("trees"), TOP, fanout))
    return whole.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
