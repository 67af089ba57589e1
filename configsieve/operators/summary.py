"""Run-level figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processing_summary(results: DataFrame) -> DataFrame:
    """One row: files in total, with a configuration, without one; answers that were not JSON, and missing ones."""
    total, succeeded = F.count(F.lit(1)), F.count("config")
    return results.agg(
        total.alias("total_files"),
        succeeded.alias("successful_files"),
        (total - succeeded).alias("failed_files"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unusable_answers", "missing_answers")),
    )
