"""Byte sequences, one a row: predictors, splits, runs and symbol statistics, in whole-array steps inside the row.

Nothing is exploded or shuffled but the statistics that each batch has summed already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType


def over_bytes(df: DataFrame, key: str, data: Column, columns: str, summary: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(key, columns): what ``summary`` makes of each row's bytes; rows without bytes are left out."""
    schema = StructType.fromDDL(f"{key} long, {columns}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            rows = [(k, *summary(np.frombuffer(b, np.uint8))) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(kinds)], kinds.names)

    return df.select(key, data.alias("data")).where("octet_length(data) > 0").mapInArrow(scan, schema)


def split_halves(b: np.ndarray) -> np.ndarray:
    """Even bytes first, odd bytes after them."""
    return np.concatenate((b[::2], b[1::2]))


def differences(b: np.ndarray) -> np.ndarray:
    """Differences of neighbours, moved by 128, modulo 256; the first byte stays."""
    out = b.copy()
    out[1:] = b[1:] - b[:-1] + np.uint8(128)
    return out


def sums(d: np.ndarray) -> np.ndarray:
    """Undoes ``differences``."""
    steps = d.astype(np.int64)
    steps[1:] -= 128
    return (np.cumsum(steps) & 255).astype(np.uint8)


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal bytes: first places, bytes and lengths."""
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return first, b[first], np.diff(np.append(first, len(b)))


def symbol_counts(df: DataFrame, data: str) -> DataFrame:
    """(b, n): how often each byte occurs; a task sums its own before anything moves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py() or b"", np.uint8), minlength=256)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["b", "n"])

    return df.select(data).mapInArrow(scan, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))


def value_bitmap(rows: DataFrame, value: str = "v") -> DataFrame:
    """Distinct values but 0, as bitmaps of 32768 values a bucket."""
    return rows.where(F.col(value) != 0).groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap"))


def running_offsets(chunks: DataFrame, keys: Sequence[str], order: str, size: Column, start: Column) -> DataFrame:
    """Where each chunk begins, from the sizes of those before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("chunk_offset", start + F.coalesce(F.sum(size).over(before), F.lit(0)))
