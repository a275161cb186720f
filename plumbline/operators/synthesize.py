"""Rows for entities that a source doesn't list, cloned from a sibling's rows under caps.

Pairs are (pair_idx, target, donor) in their declared order. Rows carry their
resolved ``entity``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cuts import cut, tables
from plumbline.operators.rank import placed

MARK = "SynthesizedFromModelName"


def donations(rows: DataFrame, pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """Donor rows beside the pairs that ask for them; the target must be registered."""
    asked = pairs.join(registry.select(F.col("entity").alias("target"), F.col("display").alias("target_display")), "target")
    return rows.filter("entity is not null").join(asked, F.col("entity") == F.col("donor"))


def kept_pairs(emitting: DataFrame, sizes: DataFrame, cap: float) -> DataFrame:
    """(source_id, pair_idx): of pairs that find a donor, those before a source's cap.

    ``emitting``: (source_id, pair_idx); ``sizes``: (source_id, n_rows). A pair
    is dropped once the pairs before it are over the cap, together with all
    later ones; so the number of pairs before it decides.
    """
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("pair_idx")) - 1
    run = emitting.withColumn("before", place).join(sizes, "source_id")
    return run.filter((F.col("before") == 0) | (F.col("before") / (F.col("n_rows") + F.col("before")) <= F.lit(cap))).select("source_id", "pair_idx")


def cloned(given: DataFrame, *keep: str) -> DataFrame:
    """Donor rows under the target's name; the vendor hint stays the donor's."""
    marked = F.map_concat(F.map_filter("fields", lambda k, _: k != MARK), F.create_map(F.lit(MARK), F.col("model_name")))
    return given.select("source_id", "seq", "pair_idx", *keep, F.col("target_display").alias("model_name"), "vendor_hint", marked.alias("fields"), F.col("donor").alias("synthesized_from"), F.col("target").alias("entity"))


def synthesize(rows: DataFrame, pairs: DataFrame, registry: DataFrame, cap: float) -> DataFrame:
    """Rows and clones of one pass, where no donor is itself cloned: a join and a running sum."""
    given = donations(rows, pairs, registry)
    emitting = given.select("source_id", "pair_idx").distinct()
    sizes = rows.groupBy("source_id").agg(F.count("*").alias("n_rows"), F.max("seq").alias("last"))
    kept = kept_pairs(emitting, sizes.select("source_id", "n_rows"), cap)
    new = cloned(given.join(kept, ["source_id", "pair_idx"])).join(sizes.select("source_id", "last"), "source_id")
    numbered = placed(new, "source_id", "pair_idx", ["seq"], down=False)
    return rows.unionByName(numbered.withColumn("seq", F.col("last") + F.col("place")).select(*rows.columns))


def synthesis_stats(emitting: DataFrame, kept: DataFrame, clones: DataFrame) -> DataFrame:
    """(source_id, n_clones, capped): rows that a source was given, and whether its cap stopped pairs of it."""
    given = clones.groupBy("source_id").agg(F.count("*").alias("n_clones"))
    stopped = emitting.join(kept, ["source_id", "pair_idx"], "left_anti").select("source_id").distinct().withColumn("capped", F.lit(True))
    every = emitting.select("source_id").distinct().join(given, "source_id", "left").join(stopped, "source_id", "left")
    return every.select("source_id", F.coalesce("n_clones", F.lit(0)).alias("n_clones"), F.coalesce("capped", F.lit(False)).alias("capped"))


def joined_up(first: DataFrame, then: DataFrame, *more) -> DataFrame:
    """Chains (start, donor, last, target) of ``first`` that go on as one of ``then``, whose pairs all come later."""
    a, b = first.alias("a"), then.alias("b")
    met = a.join(b, (F.col("a.target") == F.col("b.donor")) & (F.col("a.last") < F.col("b.start")))
    return met.select("a.start", "a.donor", "b.last", "b.target", *more)


def emissions(present: DataFrame, pairs: DataFrame, written) -> DataFrame:
    """(source_id, pair_idx, target, donor) of the pairs that find a donor at a source: a listed entity, or the target of an earlier such pair.

    ``present``: (source_id, entity). A pair does if a chain of ever later pairs
    leads to it from a donor that the source lists. Which pair leads to which is
    the same for all sources; chains are joined end to end, so that they double
    from round to round.
    """
    chains = written(pairs.select(F.col("pair_idx").alias("start"), "donor", F.col("pair_idx").alias("last"), "target"))
    n, before = chains.count(), -1
    while n != before:
        chains, before = written(chains.unionByName(joined_up(chains, chains)).distinct()), n
        n = chains.count()
    reached = present.join(chains, F.col("donor") == F.col("entity")).select("source_id", F.col("last").alias("pair_idx")).distinct()
    return written(reached.join(pairs, "pair_idx").select("source_id", "pair_idx", "target", "donor"))


def lineages(kept: DataFrame, present: DataFrame, written) -> DataFrame:
    """(source_id, pair_idx, target, donor, origin, trail): whose rows the clones of each kept pair go back to, by the pairs of ``trail``.

    A donor gives the rows that it lists and the clones that earlier pairs gave
    it. Chains of kept pairs double from round to round, each made once: of its
    first half, which has the length of the round, and a rest of up to that. A
    source keeps all pairs before its last one, so a chain is kept where its last
    pair is.
    """
    pairs = kept.select("pair_idx", "target", "donor").distinct()
    every = half = written(pairs.select(F.col("pair_idx").alias("start"), "donor", F.col("pair_idx").alias("last"), "target", F.array("pair_idx").alias("chain")))
    length = 1
    while True:
        longer = written(joined_up(half, every, F.concat("a.chain", "b.chain").alias("chain")))
        if longer.isEmpty():
            break
        length *= 2
        every, half = every.unionByName(longer), longer.filter(F.size("chain") == length)
    listed = present.join(every.withColumnRenamed("donor", "origin"), F.col("entity") == F.col("origin"))
    trail = F.reverse(F.slice("chain", 1, F.size("chain") - 1))
    return listed.select("source_id", F.col("last").alias("pair_idx"), "origin", trail.alias("trail")).join(kept, ["source_id", "pair_idx"]).select("source_id", "pair_idx", "target", "donor", "origin", "trail")


def listing(rows: DataFrame) -> DataFrame:
    """(source_id, entity, n_rows, last): the rows of each source and entity, and their greatest seq."""
    return rows.groupBy("source_id", "entity").agg(F.count("*").alias("n_rows"), F.max("seq").alias("last"))


def chained_clones(rows: DataFrame, pairs: DataFrame, registry: DataFrame, cap: float) -> tuple[DataFrame, DataFrame]:
    """Clones of rows and of clones, with their pair_idx and trail, and (source_id, n_rows, last) of the sources.

    Rows are gone through twice: for what sources list, which is written, and for what is cloned of them.
    Which pairs emit doesn't depend on later ones, and a source's cap stops all
    pairs from some point on; so first all that could emit are found, then the
    cap is applied to these, and then lineages are followed through what is left.
    """
    names = registry.select(F.col("entity").alias("target"), F.col("display").alias("target_display"))
    with tables(rows.sparkSession) as written:
        known = written(pairs.join(names.select("target"), "target").select("pair_idx", "target", "donor"))
        listed = written(listing(rows))
        sizes = cut(listed.groupBy("source_id").agg(F.sum("n_rows").alias("n_rows"), F.max("last").alias("last")))
        present = listed.filter("entity is not null").select("source_id", "entity")
        could = emissions(present, known, written)
        kept = written(could.join(kept_pairs(could.select("source_id", "pair_idx"), sizes.select("source_id", "n_rows"), cap), ["source_id", "pair_idx"]))
        found = cut(lineages(kept, present, written))
    shown = registry.select(F.col("entity").alias("donor"), F.col("display").alias("donor_display"))
    asked = found.join(names, "target").join(shown, "donor", "left").withColumnRenamed("source_id", "__source")
    given = rows.join(asked, (F.col("source_id") == F.col("__source")) & (F.col("entity") == F.col("origin")))
    # a clone that is cloned bears the name that its pair gave it
    named = given.withColumn("model_name", F.when(F.size("trail") > 0, F.col("donor_display")).otherwise(F.col("model_name")))
    return cloned(named, "trail"), sizes


def synthesize_chained(rows: DataFrame, pairs: DataFrame, registry: DataFrame, cap: float) -> DataFrame:
    """As synthesize(), but clones may donate to later pairs."""
    clones, sizes = chained_clones(rows, pairs, registry, cap)
    new = placed(clones, "source_id", "pair_idx", ["trail", "seq"], down=False)
    return rows.unionByName(new.join(sizes.select("source_id", "last"), "source_id").withColumn("seq", F.col("last") + F.col("place")).select(*rows.columns))


def stale_pairs(pairs: DataFrame, cells: DataFrame, registry: DataFrame) -> DataFrame:
    """(target, donor) of registered targets that no borrowed cell of that donor is left of; ``cells`` has entity and donor."""
    known = pairs.join(registry.select(F.col("entity").alias("target")), "target", "left_semi")
    return known.join(cells.select(F.col("entity").alias("target"), "donor").distinct(), ["target", "donor"], "left_anti").select("target", "donor").distinct()


def cap_blocked(capped: DataFrame, uncapped: DataFrame) -> DataFrame:
    """(entity, source_id) that only the run without a cap covers."""
    cover = lambda df: df.filter("entity is not null").select("entity", "source_id").distinct()
    return cover(uncapped).join(cover(capped), ["entity", "source_id"], "left_anti")
