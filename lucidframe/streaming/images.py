"""Image files as a stream: a folder's new files, decoded statelessly.  An extension; there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucidframe.session import own_folder
from lucidframe.sources.exr import frames


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """(path, content) of files as they come in."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def stream_rows(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return frames.file_rows(stream_files(spark, folder, files_per_batch))


def stream_pixels(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return frames.pixels(stream_rows(spark, folder, files_per_batch))


def stream_parts(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return frames.parts(stream_files(spark, folder, files_per_batch))


def drain(stream: DataFrame) -> DataFrame:
    """All that a stateless stream has now, as a table.

    Tasks append each batch's rows to Parquet files below the shared folder, so that the driver is sent the names of new
    files alone, and no batch writes again what earlier ones have given.  The files go when the application ends.
    """
    spark = stream.sparkSession
    rows, log = own_folder(spark), own_folder(spark)
    running = stream.writeStream.outputMode("append").format("parquet").option("path", rows).option("checkpointLocation", log).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)
