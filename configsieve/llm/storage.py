"""Tables that outlive the job that wrote them, in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only in local mode.

    Local mode runs in one process, so its folder is shared by all there is.
    Elsewhere an unset folder is an error: executors could not read each
    other's files.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(frame: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """The frame written to the shared folder and read back.

    The rows are then fixed, also if executors are lost later, and are not
    computed again for each of their uses.  A file has at most `file_rows` rows, if given.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    write = frame.write.option("maxRecordsPerFile", file_rows) if file_rows else frame.write
    write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """Have whole texts go to Python in small batches from now on, for jobs of many stages.

    Buffers of a batch are pooled on both sides and never given back, so an
    executor holds what the largest batches of all stages took.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def small_bytes(spark: SparkSession) -> None:
    """Have rows go to Python in batches that are small in bytes from now on, whatever their number."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, BATCH[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
