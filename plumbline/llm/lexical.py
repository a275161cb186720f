"""Ranked lexical search by TPUT over term-partitioned postings (operator 12).

Postings (term, document, impact) are made for the terms of the items, whole
lists, and dealt by term and by a slice of the documents, so that the list of a
common term isn't in one task. An item's score of a document is the sum of the
impacts of its terms there. The best ``k`` are found in three phases.

1. Each list gives its head, its ``k`` greatest impacts. The k-th greatest partial
   sum of an item is a lower bound of its k-th score.
2. Every list of an item is read down to one threshold, the greatest at which a
   document that no list shows can't reach the bound. The sums of what is read
   raise the bound; a document whose sum, with the most that each list can add
   that hasn't shown it, stays below it is out.
3. The exact scores of the candidates: what the lists hold of them below the
   threshold is looked up and added.

No document is passed over that could be among the best; ties stand in the
order of doc_id. Arithmetic is that of whole numbers, but for the logarithm.

Null and empty texts have no terms; N, L and df count all rows. Rows are
documents of their own, also if they repeat an id; a null id stands first among
ties. Items of one id are one, with the terms of all; items without terms get
nothing. Very long texts are read whole. Empty tables give no rows. Other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, cut, named, raw, small, tables
from plumbline.llm.decontaminate import FOLD

#: Best documents of an item; documents in a slice of a list.
BEST, SLICE = 50, 20_000


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def counted(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with n_terms and terms: (name, tf) of the whole text. Terms are runs of letters, digits and characters beyond ASCII."""

    def make():
        def work(column):
            found = [Counter(x.translate(FOLD).split()) for x in raw(column)]
            offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
            terms = pa.array([t.decode() for c in found for t in c], pa.string())
            tfs = pa.array([n for c in found for n in c.values()], pa.int64())
            pairs = pa.StructArray.from_arrays([terms, tfs], ["name", "tf"])
            return [pa.array([c.total() for c in found], pa.int64()), pa.ListArray.from_arrays(offsets, pairs)]

        return work

    return add_columns(df, text, make, "n_terms long, terms array<struct<name: string, tf: long>>", keep)


def postings(df: DataFrame, wanted: DataFrame, text: str, id_col: str, written: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(term, doc, n, tf) of the ``wanted`` (name, term); (doc, doc_id, n) of all rows."""
    docs = df.select(named(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("doc"), named(text).alias("text"))
    each = counted(docs, "text", ["doc_id", "doc"])
    # texts are read once: a document's own row, of no term, is written beside its postings
    own = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("tf")))
    rows = each.select("doc_id", "doc", F.col("n_terms").alias("n"), F.inline(F.concat(F.col("terms"), own)))
    known = rows.join(small(wanted.withColumnRenamed("name", "wanted")), F.col("name") == F.col("wanted"), "left").filter("name is null or term is not null")
    kept = written(known.select("term", "doc", F.when(F.col("name").isNull(), F.col("doc_id")).alias("doc_id"), "n", "tf"))
    return kept.filter("term is not null").select("term", "doc", "n", "tf"), kept.filter("term is null").select("doc", "doc_id", "n")


def weighted(lists: DataFrame, docs: int, terms: int) -> DataFrame:
    """(term, doc, impact), without impacts of 0, dealt by term and, of a term, by slices of the documents."""
    df = small(cut(lists.groupBy(F.col("term").alias("of")).agg(F.count("*").alias("df"))))
    long = lambda x: F.lit(x).cast("long")
    w = F.floor(1000 * F.log((2 * long(docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    m = long(50) + div(long(50) * F.col("n") * long(docs), long(max(1, terms)))
    impact = w * div(long(1_000_000_000) * F.col("tf"), long(1000) * F.col("tf") + long(20) * m)
    made = lists.join(df, F.col("term") == F.col("of")).select("term", "doc", impact.alias("impact")).filter("impact > 0")
    return made.repartition("term", F.pmod(F.xxhash64("doc"), F.lit(1 + docs // SLICE)))


def kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound): the ``k``-th greatest partial sum of each item; 0 for one that has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    best = sums.select("item", "score").withColumn("place", place).filter(F.col("place") <= k)
    return best.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).cast("long").alias("bound"))


def thresholds(lengths: DataFrame, bounds: DataFrame) -> DataFrame:
    """(item, term, cap, unseen): the greatest threshold of all lists of an item at which a document that none shows stays below the item's bound.

    ``lengths``: (item, term, most), the greatest impact of each list. Such a
    document has min(threshold, most) of each list at most. Lists that lie below
    the threshold as a whole leave more to the others, so it follows from running
    sums in the order of ``most``: it rises while lists lie below it.
    """
    by_item = Window.partitionBy("item")
    before = by_item.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, -1)
    ruled = lengths.join(bounds, "item").withColumn("below", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("left", F.count("*").over(by_item) - F.row_number().over(by_item.orderBy("most", "term")) + 1)
    level = div(F.greatest(F.col("bound") - 1 - F.col("below"), F.lit(0).cast("long")), F.col("left"))
    ruled = ruled.withColumn("unseen", F.max(level).over(by_item))
    return ruled.select("item", "term", F.least("unseen", "most").alias("cap"), "unseen")


def tput(lists: DataFrame, asked: DataFrame, k: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(item, doc, score) of all that can be among the best ``k`` of an item; ``lists``: (term, doc, impact), ``asked``: (item, term)."""
    asked = cut(asked.join(lists.select("term").distinct(), "term", "left_semi"))
    heads = cut(lists.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "doc"))).filter(F.col("place") <= k))
    first = heads.join(small(asked), "term").groupBy("item", "doc").agg(F.sum("impact").alias("score"))
    bounds = cut(kth(first, k))
    lengths = asked.join(small(heads.filter("place = 1").select("term", F.col("impact").alias("most"))), "term")
    ruled = cut(thresholds(lengths, bounds))
    levels = small(ruled)
    # rows go to their documents once, however many items read them, and are summed there
    lowest = small(cut(ruled.groupBy("term").agg(F.min("unseen").alias("lowest"))))
    read = lists.join(lowest, "term").filter("impact > lowest").select("term", "doc", "impact").repartition("doc")
    shown = read.join(levels, "term").filter("impact > unseen")
    partial = written(shown.groupBy("item", "doc").agg(F.sum("impact").alias("score"), F.sum("cap").alias("shown")))
    caps = ruled.groupBy("item").agg(F.sum("cap").alias("caps"))
    rest = small(cut(caps.join(kth(partial, k), "item")))
    candidates = written(partial.join(rest, "item").filter("score + caps - shown >= bound").select("item", "doc", "score"))
    # of the candidates what the lists hold below the threshold
    more = lists.join(levels, "term").filter("impact <= unseen").select("item", "doc", F.col("impact").alias("score"))
    more = more.join(candidates.select("item", "doc"), ["item", "doc"], "left_semi")
    return candidates.unionByName(more).groupBy("item", "doc").agg(F.sum("score").alias("score"))


def search(df: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` rows of ``df`` for each item. Runs its jobs, and keeps the result alone."""
    words = counted(items.select(named(item_id).alias("item_id"), named(item_text).alias("text")), "text", ["item_id"])
    given = cut(words.select("item_id", F.explode("terms.name").alias("name")).distinct())
    ids = cut(given.select(F.col("item_id").alias("same")).distinct().withColumn("item", F.monotonically_increasing_id()))
    wanted = cut(given.select("name").distinct().withColumn("term", F.monotonically_increasing_id()))
    asked = given.join(ids, F.col("item_id").eqNullSafe(F.col("same"))).join(wanted, "name").select("item", "term")
    with tables(df.sparkSession) as written:
        lists, docs = postings(df, wanted, text, id_col, written)
        sums = docs.filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        scored = tput(written(weighted(lists, sums.docs, sums.terms)), asked, k, written).join(docs.select("doc", "doc_id"), "doc")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "doc"))
        best = scored.withColumn("rank", place).filter(F.col("rank") <= k)
        return cut(best.join(small(ids), "item").select(F.col("same").alias("item_id"), "rank", "doc_id", "score"))
