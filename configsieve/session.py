"""Session settings the operators rely on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

THREAD_STACK = "-Xss4m"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Split hot join keys and merge small shuffle partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Python repeats a key with the last value winning.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Spark writes a VARIANT as JSON by recursion; 1,000 levels may be too many for the stack of 1 MB.
    "spark.driver.extraJavaOptions": THREAD_STACK,
    "spark.executor.extraJavaOptions": THREAD_STACK,
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the recommended settings."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
