"""Settling intermediate results of long jobs."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="configsieve-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, a temporary folder in local mode and an error elsewhere."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")


def settled(frame: DataFrame, name: str) -> DataFrame:
    """The frame read back from a table in the shared folder.

    What is expensive or outside Spark's control (parsed files, answers) is then
    computed once, also when executors are lost later.
    """
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
