"""What a run couldn't place: unmatched names, gaps of coverage, siblings that could fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import name_in_vendor, normalize_name, token_overlap, tokens, vendor_of_id
from plumbline.functions.values import round_half_up
from plumbline.operators.cuts import cut

#: Least overlap of a sibling's name, and how many are listed (fixed values).
OVERLAP, SIBLINGS = 0.6, 3


def sample_fields(fields: Column, most: int = 3) -> Column:
    """The first few entries of a map in the order of their keys, as 'key=value'."""
    return F.transform(F.slice(F.array_sort(F.map_keys(fields)), 1, most), lambda k: F.concat_ws("=", k, F.element_at(fields, k)))


def unmatched_groups(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """(source_id, vendor_norm, name_norm, count, example_name, sample_fields) of rows without an entity."""
    rest = rows.filter("entity is null").withColumn("vendor_norm", normalize_name(F.coalesce("vendor_hint", F.lit("")))).withColumn("name_norm", normalize_name(F.col("model_name")))
    first = F.min_by(F.struct("model_name", sample_fields(F.col("fields")).alias("sample")), "seq")
    groups = rest.groupBy("source_id", "vendor_norm", "name_norm").agg(F.count("*").alias("count"), first.alias("x"))
    return groups.filter(F.col("count") >= min_count).select("source_id", "vendor_norm", "name_norm", "count", F.col("x.model_name").alias("example_name"), F.col("x.sample").alias("sample_fields"))


def coverage_gaps(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(entity, source_id) of sources that list nothing of an entity.

    Each entity has the array of all sources, which is one row; those that it is
    found at are taken away before the rest is exploded, so only true gaps
    become rows.
    """
    sources = rows.select("source_id").distinct().agg(F.array_sort(F.collect_list("source_id")).alias("every"))
    found = rows.filter("entity is not null").select("entity", "source_id").distinct().groupBy("entity").agg(F.collect_list("source_id").alias("own"))
    left = F.array_except("every", F.coalesce("own", F.array().cast("array<string>")))
    return registry.select("entity").join(found, "entity", "left").join(F.broadcast(sources), F.lit(True)).select("entity", F.explode(left).alias("source_id"))


def siblings(gaps: DataFrame, matched: DataFrame, registry: DataFrame, most: int = SIBLINGS, overlap: float = OVERLAP) -> DataFrame:
    """(entity, source_id, nth, sibling, overlap): rows at the source of the same vendor with a like name.

    One candidate for each row, so an entity of several rows may be listed as
    often. Candidates are found from the entities that a source has, each once:
    they share a vendor, which is that of the row's hint or else of the entity,
    and one of the rarest words of their names, as many as a name alike enough
    can't lack; rows come in for the found ones alone.
    """
    listed = registry.select("entity", F.lower("vendor").alias("vendor"), F.lower(vendor_of_id(F.col("entity"))).alias("prefix"), normalize_name(name_in_vendor(F.col("entity"))).alias("norm")).withColumn("words", tokens(F.col("norm")))
    counts = listed.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = listed.select("entity", F.explode("words").alias("word")).join(counts, "word").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    size = F.size("words")
    needed = (size - F.ceil(size * F.lit(overlap)) + 1).cast("int")
    rare = F.when(size == 0, F.array(F.lit(""))).otherwise(F.transform(F.slice("ranked", F.lit(1), F.greatest(needed, F.lit(1))), lambda x: x["word"]))
    named = cut(listed.join(ranked, "entity", "left").withColumn("rare", rare).drop("ranked", "words"))
    way = lambda by, of: F.named_struct(F.lit("by"), F.lit(by), F.lit("of"), of)
    vendors = F.array(way("vendor", F.col("vendor")), way("prefix", F.col("prefix")), way("hint", normalize_name(F.col("vendor"))))
    target = gaps.join(named, "entity").select("entity", "source_id", "norm", F.explode("rare").alias("word"), vendors.alias("ways")).select("entity", "source_id", "norm", "word", F.inline("ways"))
    hinted = F.lower(F.coalesce("vendor_hint", F.lit("")))
    own = cut(matched.select("source_id", "seq", F.col("entity").alias("sibling"), hinted.alias("hint")))
    told = named.select(F.col("entity").alias("sibling"), F.col("vendor").alias("s_vendor"), F.col("prefix").alias("s_prefix"), F.col("norm").alias("s_norm"), "rare")
    at_hand = own.select("source_id", "sibling", "hint").distinct().join(told, "sibling")
    by_self, by_hint = F.array(way("vendor", F.col("s_vendor")), way("prefix", F.col("s_prefix"))), F.array(way("hint", normalize_name(F.col("hint"))))
    at_hand = at_hand.select("source_id", "sibling", "hint", "s_norm", F.explode("rare").alias("word"), F.when(F.col("hint") != "", by_hint).otherwise(by_self).alias("ways")).select("source_id", "sibling", "hint", "s_norm", "word", F.inline("ways"))
    met = target.join(at_hand, ["source_id", "by", "of", "word"]).filter("entity <> sibling").select("entity", "source_id", "norm", "sibling", "hint", "s_norm").distinct()
    alike = met.withColumn("overlap", token_overlap(F.col("norm"), F.col("s_norm"))).filter(F.col("overlap") >= overlap)
    w = Window.partitionBy("entity", "source_id").orderBy(F.desc("overlap"), "sibling", "seq")
    rows = alike.join(own, ["source_id", "sibling", "hint"])
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("entity", "source_id", "nth", "sibling", round_half_up(F.col("overlap")).alias("overlap"))
