"""Exact duplicates by content-defined chunk recipes (operator 8).

Texts are equal when they are identical after lower-casing A-Z. Each text is
cut where its content says so, so equal passages give equal chunks. Chunks are
deduplicated to identifiers, and these are verified: the text of every distinct
chunk moves once, grouped by identifier, and an identifier with two texts makes
the operator take the chunk text itself. From then on a document is its ordered
list of identifiers, its recipe; only recipes move, and documents with equal
recipes are equal.

Only DataFrame functions are used. Null texts count as empty; all empty texts
form one group with an empty recipe. Texts of any length are read whole. Of
equal texts the row with the largest doc_id stays (null ids come before all
others); of repeated rows with that id, one stays. A hot group never meets in
one task: sizes are pre-aggregated, and the join that brings them back reads
two written tables, so that Spark splits its skewed partitions. An empty table
gives no rows; columns besides those named are never looked at, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, free, lower_ascii, named, sha256

#: Chunks of more bytes than MOST are cut again; these pieces have from LEAST to MOST characters, the last one may be shorter.
LEAST, MOST = 64, 8192
#: A text is cut behind blanks that have six characters with odd and even codes in one certain order around them, as
#: one of 64 blanks has. So cuts depend on the text beside them alone, and texts that differ in one place have the same
#: cuts again soon after. Long chunks, as of scripts without blanks, are cut behind a full stop, or else at MOST.
ODD, EVEN = ("[" + "".join(rf"\x{c:02x}" for c in range(start, 0x7F, 2)) + "]" for start in (0x21, 0x22))
CUT = rf"(?<={EVEN}{ODD}{EVEN}\x20)(?={ODD}{EVEN}{ODD})"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; together they are the text. An empty text has none."""
    further = rf"(?s).{{{least},{most - 1}}}?[。！？।۔]|.{{1,{most}}}"
    cut = F.transform(F.split(text, CUT), lambda x: F.when(F.octet_length(x) > most, F.regexp_extract_all(x, F.lit(further), F.lit(0))).otherwise(F.array(x)))
    return F.when(text != "", F.flatten(cut)).otherwise(F.array().cast("array<string>"))


def identifier(chunk: Column) -> Column:
    """Half of a SHA-256; verified() looks for clashes."""
    return F.unhex(F.substring(F.sha2(chunk.cast("binary"), 256), 1, 32))


def verified(df: DataFrame, make=identifier):
    """``make`` if no two distinct chunks of the column ``chunks`` share an identifier, else the chunk's own bytes."""
    # an inner explode would have the chunks made twice, once to look for empty arrays
    texts = df.select(F.explode_outer("chunks").alias("chunk")).filter("chunk is not null").select(make(F.col("chunk")).alias("id"), "chunk").groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    clash = texts.groupBy("id").agg(F.count("one").alias("n")).filter("n > 1")
    return make if clash.isEmpty() else lambda chunk: chunk.cast("binary")


def groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", make=identifier) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    normal = df.select(named(id_col).alias("doc_id"), lower_ascii(F.coalesce(named(text), F.lit(""))).alias("normal"))
    make = verified(normal.select(chunks(F.col("normal")).alias("chunks")), make)
    recipes = cut(
        normal.select(
            "doc_id",
            sha256(F.col("normal")).alias("text_sha256"),
            F.transform(chunks(F.col("normal")), make).alias("recipe"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    sizes = cut(recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")))
    return recipes.join(sizes, "recipe").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def deduplicated(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Of rows that share an id and a normalised text, the one that is the greatest as JSON stays.
    """
    kept = cut(groups(df, text, id_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")))
    sha = free(df, "sha256")
    keyed = df.withColumn(sha, sha256(lower_ascii(F.coalesce(named(text), F.lit("")))))
    stay = keyed.join(kept, named(id_col).eqNullSafe(F.col("kept_id")) & (F.col(sha) == F.col("kept_sha")), "left_semi")
    if df.groupBy(named(id_col)).count().filter("count > 1").isEmpty():
        return stay.drop(sha)
    whole = F.struct(*map(named, df.columns))
    one = stay.groupBy(named(id_col).alias("kept_id"), F.col(sha)).agg(F.max_by(whole, F.to_json(whole)).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
