"""Shared plumbing: table access, shared scratch folders, Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, scratch_path, shared_dir  # noqa: F401  used by the operators

#: Bytes that separate words in every operator here: space, \t, \n, \v, \f, \r (what bytes.split() splits on).
WORD_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that a worker takes from an Arrow batch at once.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame, cols: list[str] | None = None) -> Column:
    """The columns (all by default) as one struct ``row``, so that a column of the input may have any name."""
    cols = df.columns if cols is None else cols
    return (F.struct(*[field(c).alias(c) for c in cols]) if cols else F.struct(F.lit(None).cast("int").alias("_"))).alias("row")


#: A key with more than one row in HOT is joined by a broadcast of fewer than HOT rows.
HOT = 10_000


def join_spread(rows: DataFrame, by: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with ``by``, which has one row for each ``key`` and in ``n`` at least the number of rows with that key; the sum of all n is
    at most ``total``. Fewer than HOT keys have more than total / HOT rows: those are broadcast, so that no key's rows meet in one task; the
    others are spread by key. Both have the column ``key``; the result has it once, and not n."""
    many = F.col("n") > max(total, 1) / HOT
    hot, rest = F.broadcast(by.filter(many).drop("n")), by.filter(~many).drop("n")
    out = rows.join(hot, key)
    return out.unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key).select(*out.columns))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_rows(df: DataFrame, text_col: str, add: list[tuple[str, T.DataType]], fn: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None, size: int = SLICE) -> DataFrame:
    """Columns ``keep`` (all by default) in a struct ``row``, untouched, beside the columns of ``add`` that fn makes from the
    texts of an Arrow batch. A struct, so that a column of the input may have any name."""
    cols = df.columns if keep is None else keep
    inside = text_col in cols
    src = df.select(row_of(df, cols)) if inside else df.select(row_of(df, cols), field(text_col).alias("text"))
    at = cols.index(text_col) if inside else None
    schema = T.StructType([src.schema["row"], *[T.StructField(n, t) for n, t in add]])
    names = ["row", *[n for n, _ in add]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, whole.column(0).flatten()[at] if inside else whole.column(1), size):
                held = b.column(0)
                yield pa.RecordBatch.from_arrays([held, *fn(held.flatten()[at] if inside else b.column(1))], names=names)

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, by: pa.Array, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows (one at least) of about ``size`` bytes of the column ``by``, without copying."""
    n = batch.num_rows
    if pa.types.is_string(by.type) or pa.types.is_binary(by.type):
        lengths = pc.fill_null(pc.binary_length(by), 0).to_numpy(zero_copy_only=False)
    elif pa.types.is_list(by.type):
        lengths = pc.fill_null(pc.list_value_length(by), 0).to_numpy(zero_copy_only=False) * 4
    else:
        lengths = np.full(n, by.nbytes // max(n, 1))
    begun, held = 0, 0
    for i, k in enumerate(lengths.tolist()):
        if i > begun and held + k > size:
            yield batch.slice(begun, i - begun)
            begun, held = i, 0
        held += k
    if n > begun:
        yield batch.slice(begun)
