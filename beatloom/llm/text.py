"""Helpers shared by the operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def keyed(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the key, the text (null: empty) and ``more``; never the other columns."""
    return docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), *more)


def schema_of(d: DataFrame, key: str, more: str) -> StructType:
    """The key as it is in ``d``, then the fields of a DDL string."""
    return StructType([d.schema[key], *StructType.fromDDL(more)])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict | list]], schema: StructType) -> DataFrame:
    """``mapInArrow`` whose function yields columns (name to array or list).

    Arrays of an empty batch keep their types, so empty tables pass through.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            arrays = [
                c.cast(f.type) if isinstance(c := cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                for f in target
            ]
            yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=target)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "_text") -> list[str]:
    return batch.column(column).to_pylist()


def blobs(batch: pa.RecordBatch, column: str = "_text") -> list[bytes]:
    """The texts as UTF-8 bytes, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


SIFT_BITS = 1 << 23


def sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``, before any
    shuffle, by a bitmap of the hashed keys. The bitmap has a fixed size (at most
    131,072 rows of 64 bits), whatever the number of keys; when it fills up it only
    sifts less."""
    h = F.pmod(F.xxhash64(key), F.lit(SIFT_BITS))
    slot, bit = F.floor(h / 64).cast("long").alias("_slot"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))").alias("_bit")
    bitmap = ids.select(slot, bit).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.select("*", slot, bit).join(F.broadcast(bitmap), "_slot").filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return found.select(*rows.columns)


def sift(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` semi-joined with the key column of ``ids``, texts sifted first."""
    return sifted(docs, ids, key).join(ids.select(key).distinct(), key, "left_semi")
