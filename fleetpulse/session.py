"""Session helpers: the shared work folder and reliable lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is only made for a local master, where driver and
    executors share one file system; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="fleetpulse-")
    context.setCheckpointDir(made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/fleetpulse/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a cached or local copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, for results used several times."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_files(path: str):
    """File system of a path of the shared folder and the path in its terms, for Python workers (as ``pyarrow.fs`` opens it)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def free_finished(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcast blocks of finished work, which it does when the driver collects garbage.

    A driver that runs many small jobs in a row would otherwise put that off until its heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
