"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a session on one machine may go without that setting and
    without a checkpoint folder; it gets a temporary folder of this machine.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not context._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lucidframe-")
    context.setCheckpointDir(own)
    return own


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark can write to."""
    where, store = _file_system(spark, path)
    store.delete(where, True)


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/lucidframe-{uuid.uuid4().hex}"
    where, store = _file_system(spark, path)
    store.mkdirs(where)  # only what is there can be marked
    store.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet below the shared folder and reads it back.

    Unlike a localCheckpoint the written rows outlive any executor; unlike an eager checkpoint() the plan runs
    once and later reads can prune columns.  The files go with ``release`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}"
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes the files of materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None:
            delete_path(t.sparkSession, t._written.rsplit("/", 1)[0])


def bounded_batches(df: DataFrame, rows: int | None, size: int) -> DataFrame:
    """The same table; its session hands ``rows`` rows and about ``size`` bytes to a worker at once at most.

    A longer row goes alone.  Spark reads these settings of the session when a query runs, so they stay as they are set.
    """
    conf = df.sparkSession.conf
    number = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("Records", rows), ("Bytes", size)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if most and not 0 < number(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def local_session(cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.cpu_count()}]")
        .appName("lucidframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
