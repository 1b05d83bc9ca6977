"""Shared helpers: reading text columns in bounded slices and splitting words at numpy or C speed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe import session

#: Bytes of text that one slice holds, so that temporary arrays stay small; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a blank.
ALNUM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that Spark hands to a worker at once; texts may be long, so its defaults would fill a small executor.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table; its session hands BATCH_ROWS rows and about BATCH_BYTES bytes to a worker at once at most."""
    return session.bounded_batches(df, BATCH_ROWS, BATCH_BYTES)


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, whatever else the table holds."""
    return bounded_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts as UTF-8) of a few rows at a time, at most ``limit`` bytes unless one text alone has more."""
    for batch in batches:
        ids, size, a = batch.column(0).to_pylist(), 0, 0
        column = batch.column(1)
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        texts = column.to_pylist()
        for b, x in enumerate(texts):
            n = len(x) if x else 0
            if size + n > limit and b > a:
                yield ids[a:b], texts[a:b]
                a, size = b, 0
            size += n
        if a < len(ids):
            yield ids[a:], texts[a:]
