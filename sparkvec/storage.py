"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what the context has, else ``spark.checkpoint.dir``. Under a local master without
    either, where driver and executors are one process, a temporary folder that goes when Python ends."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: what follows survives lost executors, and reads the same rows in
    the same partitions and order however often it is evaluated. Spark removes the files when it no longer needs them if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(table: DataFrame) -> DataFrame:
    """A table's scan, dealt anew if it has fewer partitions than the session has cores, as that of a small file has, which may
    be one row group and so one task. A table of more splits, as any large one has, stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
