"""Labelled rows that classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, about; the bound on what is broadcast.
FIT_ROWS = 20_000


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def fit_labels(labels: DataFrame, column: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, label (0 or 1) and fold of about `rows` labelled documents that are not held out.

    Where a document has several labels the more frequent one counts, 1 if
    both are.  Rows without id or label are left out.  A hash of the id picks
    the sample when there are more rows than that.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share, scale = min(1.0, rows / max(known.count(), 1)), 1 << 40
    picked = one.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(scale)) < int(share * scale))
    return picked.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that have a label.  `labels` comes from `fit_labels` and so is bounded."""
    return rows.join(F.broadcast(labels), "doc_id")
