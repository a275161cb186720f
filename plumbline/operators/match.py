"""Free-text names onto a registry of entities: exact in tiers, then by containment.

A key is found inside longer ones by its rarest piece, so keys that all begin
alike aren't all compared. The registry is (entity, ord, vendor, display, aliases). Names are made
distinct first, so that a name is matched once however many rows bear it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import alphanumeric, compact_key, normalize_name, stripped_forms
from plumbline.operators.cuts import cut

#: Of matching by containment: score of equality, of the vendor, and the least score (fixed values).
EQUAL, VENDOR, LEAST = 100, 20, 12
#: Letters of the pieces by which keys are found inside others.
GRAM = 4


def registry_keys(registry: DataFrame) -> DataFrame:
    """(entity, ord, vendor, key_ord, norm, compact): id, display name and sorted aliases of each entity."""
    names = F.concat(F.array("entity", "display"), F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))))
    each = registry.select("entity", "ord", "vendor", F.posexplode(names).alias("key_ord", "key"))
    return each.withColumn("norm", normalize_name(F.col("key"))).withColumn("compact", alphanumeric(F.col("norm"))).drop("key")


def alias_index(keys: DataFrame) -> DataFrame:
    """(kind, key, entity): of entities that share a key, the first has it."""
    both = keys.select("entity", "ord", F.explode(F.array(F.struct(F.lit("norm").alias("kind"), F.col("norm").alias("key")), F.struct(F.lit("compact").alias("kind"), F.col("compact").alias("key")))).alias("k"))
    return both.filter("k.key <> ''").groupBy("k.kind", "k.key").agg(F.min_by("entity", "ord").alias("entity"))


def candidates(name: Column, hint: Column) -> Column:
    """The name, and the name behind its vendor in three ways."""
    ways = F.array(name, *[F.concat(hint, F.lit(mark), name) for mark in (" ", "/", ":")])
    return F.when(F.coalesce(hint, F.lit("")) != "", ways).otherwise(F.array(name))


def exact(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, hint, entity) of the names that an exact key finds: whole names first, then names without endings."""
    tried = names.select("name", "hint", F.posexplode(candidates(F.col("name"), F.col("hint"))).alias("c", "way")).withColumn("norm", normalize_name(F.col("way")))
    forms = F.concat(F.array("norm"), stripped_forms(F.col("norm")))
    each = tried.select("name", "hint", "c", F.posexplode(forms).alias("s", "form"))
    kinds = F.array(F.struct(F.lit(0).alias("k"), F.lit("norm").alias("kind"), F.col("form").alias("key")), F.struct(F.lit(1).alias("k"), F.lit("compact").alias("kind"), alphanumeric(F.col("form")).alias("key")))
    keyed = each.select("name", "hint", F.least("s", F.lit(1)).alias("tier"), "c", "s", F.explode(kinds).alias("x")).select("name", "hint", "tier", "c", "s", "x.k", "x.kind", "x.key")
    hits = keyed.join(index, ["kind", "key"])
    return hits.groupBy("name", "hint").agg(F.min_by("entity", F.struct("tier", "c", "s", "k")).alias("entity"))


def grams(key: Column, size: int = GRAM) -> Column:
    """All pieces of ``size`` letters of a key; none of a shorter one."""
    n = F.length(key) - size + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(key, i, F.lit(size)))))


def own_pieces(key: Column) -> Column:
    """The pieces by which a key is looked up inside longer ones: runs of GRAM letters, or all of a shorter key."""
    return F.when(F.length(key) < GRAM, F.array(key)).otherwise(grams(key))


def candidates_of(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): each key of ``short`` with the keys of ``long`` that hold its rarest piece; both have one column of distinct keys.

    Pieces of ``long`` are an inverted index with the number of keys that hold
    each. A key one of whose pieces is in none of them is in none of them either.
    """
    index = long.toDF("long").select("long", F.explode(F.concat(*[grams(F.col("long"), size) for size in range(1, GRAM + 1)])).alias("piece"))
    held = index.groupBy("piece").agg(F.count("*").alias("n"))
    asked = short.toDF("short").select("short", F.explode(own_pieces(F.col("short"))).alias("piece")).join(held, "piece", "left")
    rarest = asked.groupBy("short").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.bool_and(F.col("n").isNotNull()).alias("everywhere"))
    return rarest.filter("everywhere").join(index, "piece").select("short", "long")


def fuzzy(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(name, hint, entity, score) of names one of whose keys contains the other, whichever is the shorter, and however short."""
    own = names.withColumn("compact", compact_key(F.col("name"))).filter("compact <> ''").withColumn("hint_norm", normalize_name(F.coalesce("hint", F.lit(""))))
    listed = keys.filter("compact <> ''").select("entity", "ord", "key_ord", F.col("compact").alias("alias"), normalize_name(F.coalesce("vendor", F.lit(""))).alias("vendor_norm")).dropDuplicates(["entity", "alias"])
    own, listed = cut(own), cut(listed)
    ours, theirs = own.select("compact").distinct(), listed.select("alias").distinct()
    inside = candidates_of(theirs, ours).filter(F.col("long").contains(F.col("short"))).toDF("alias", "compact")
    around = candidates_of(ours, theirs).filter(F.col("long").contains(F.col("short"))).toDF("compact", "alias")
    pairs = inside.unionByName(around).distinct()
    bonus = F.when((F.col("hint_norm") != "") & (F.col("hint_norm") == F.col("vendor_norm")), VENDOR).otherwise(0)
    score = F.when(F.col("alias") == F.col("compact"), EQUAL).otherwise(F.least(F.length("alias"), F.length("compact"))) + bonus
    need = F.greatest(F.lit(LEAST), F.floor(F.length("compact") / 2).cast("int"))
    scored = own.join(pairs, "compact").join(listed, "alias").withColumn("score", score).filter(F.col("score") >= need)
    best = scored.groupBy("name", "hint").agg(F.min_by(F.struct("entity", "score"), F.struct((-F.col("score")).alias("s"), "ord", "key_ord")).alias("b"))
    return best.select("name", "hint", "b.entity", "b.score")


def resolve(rows: DataFrame, registry: DataFrame, name: str = "model_name", hint: str = "vendor_hint") -> DataFrame:
    """Add ``entity`` to rows: NULL where no entity matches."""
    keys = cut(registry_keys(registry))
    names = cut(rows.select(F.col(name).alias("name"), F.col(hint).alias("hint")).distinct())
    found = cut(exact(names, alias_index(keys)))
    same = lambda a, b: a["name"].eqNullSafe(b["name"]) & a["hint"].eqNullSafe(b["hint"])
    rest = names.join(found, same(names, found), "left_anti")
    every = found.unionByName(fuzzy(rest, keys).drop("score")).select(F.col("name").alias("__name"), F.col("hint").alias("__hint"), "entity")
    return rows.join(every, F.col(name).eqNullSafe(F.col("__name")) & F.col(hint).eqNullSafe(F.col("__hint")), "left").drop("__name", "__hint")
