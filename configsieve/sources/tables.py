"""Reading text tables, and dealing rows that grow on the way."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one task, and rows below which a task of its own is not worth it.
ROWS_PER_TASK, FEWEST_ROWS = 16_384, 1_024


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it is: its row groups are the splits, and its texts do not move."""
    return spark.read.parquet(path)


def dealt(rows: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows, dealt evenly over tasks of at most about ``per_task`` rows.

    For narrow rows that much is made of: a million of them fit into a file of one
    row group, and one task would make, search and sort all that comes of them.
    Dealt by place and not by value, so that no value is hot; the number of tasks is
    fixed, because adaptive execution would go by the bytes of the narrow rows.
    """
    count = rows.count()
    tasks = max(ceil(count / per_task), min(rows.sparkSession.sparkContext.defaultParallelism, ceil(count / FEWEST_ROWS)), 1)
    return rows.repartition(tasks, F.monotonically_increasing_id())
