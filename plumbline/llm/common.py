"""What the operators of this subpackage share: reading, lineage cuts, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cuts import cut, remove, shared_folder, tables  # noqa: F401

#: Bytes of text that a Python task handles at a time.
SLICE_BYTES = 4_000_000
#: Beyond so many rows a side isn't broadcast.
MOST_BROADCAST = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it a name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it is counted to be small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of ``column``.

    A single longer value makes a batch of its own.
    """
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def add_columns(df: DataFrame, text: str, make, added: str, keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Add columns that Python tasks compute from whole texts, slice by slice.

    ``make()`` is called once a task and gives a function from an Arrow text
    column to a list of Arrow columns, one for each field of the DDL ``added``;
    it may also be a generator of (offset, rows, columns) pieces. Columns of
    ``df`` outside ``keep`` (None: all) go; one named like an added column is
    replaced by it.
    """
    from pyspark.sql.types import StructField, StructType

    fields = StructType.fromDDL(added)
    own = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    # within the task columns go by number: their names may be any
    passed = [f"c{i}" for i in range(len(own))]
    schema = StructType([StructField(p, df.schema[c].dataType, True) for p, c in zip(passed, own, strict=True)] + fields.fields)

    def run(batches):
        work = make()
        for part in slices(batches, "text", most):
            done = work(part.column("text"))
            for at, n, columns in [(0, part.num_rows, done)] if isinstance(done, list) else done:
                piece = part.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in passed), *columns], schema.names)

    given = [named(c).alias(p) for p, c in zip(passed, own, strict=True)]
    return df.select(*given, named(text).cast("string").alias("text")).mapInArrow(run, schema).toDF(*own, *fields.names)
