"""Deep pixels: a variable number of samples each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lucidframe.functions.color import unpremultiply


def sample_counts(pixels: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples of every pixel, 0 where there are none."""
    counted = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    return pixels.join(counted, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def cumulative_offsets(counts: DataFrame, line: Sequence[str], at: str = "x") -> DataFrame:
    """Inclusive running counts along each line; the last is the line's number of samples."""
    w = Window.partitionBy(*line).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("sample_end", F.sum("n").over(w))


def counts_from_offsets(offsets: DataFrame, line: Sequence[str], at: str = "x") -> DataFrame:
    before = F.lag("sample_end").over(Window.partitionBy(*line).orderBy(at))
    return offsets.withColumn("n_again", F.col("sample_end") - F.coalesce(before, F.lit(0)))


def implode(samples: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Samples of a pixel as a sorted array of structs."""
    return samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("samples"))


def explode(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.select(*keys, F.posexplode("samples").alias("s", "v")).select(*keys, "s", "v.*")


def unpremultiplied(samples: DataFrame, color: str, alpha: str, scale: float = 1.0) -> DataFrame:
    return samples.withColumn("straight", unpremultiply(F.col(color), F.col(alpha), scale))
