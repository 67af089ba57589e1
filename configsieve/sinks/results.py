"""Writing one configuration row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INVALID_SCHEMA, MISSING_PROPERTY, UNSUPPORTED_TYPE, WRONG_TYPE
from ..plans.lineage import settled

MASKED_TYPES = ("credentials", "connection_string")


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines ``{"path": ..., "config": {...} or null}``, in parallel."""
    results.select("path", "config").write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_result_map(results: DataFrame, path: str, mode: str = "error") -> None:
    """Part files that, put one after the other, are one JSON object ``{path: config or null}``.

    The results are computed once and written as entries; sorting samples those,
    and the least path, known then, is the entry without a comma.  Range
    partitioning sorts, so no task holds the map.
    """
    entries = settled(results.select("path", F.coalesce(F.to_json("config"), F.lit("null")).alias("config")), "entries")
    first = entries.agg(F.min("path")).scalar()
    name = F.to_json(F.struct(F.col("path").alias("p")))
    quoted = F.expr("substring(name, 6, length(name) - 6)")
    comma = F.when(F.col("path") == first, F.lit("  ")).otherwise(F.lit(", "))
    lines = entries.withColumn("name", name).select(
        F.lit(1).alias("part"), "path", F.concat(comma, quoted, F.lit(": "), "config").alias("value"))
    spark = results.sparkSession
    frame = spark.range(2).select(
        (F.col("id") * 2).cast("int").alias("part"), F.lit("").alias("path"),
        F.when(F.col("id") == 0, F.lit("{")).otherwise(F.lit("}")).alias("value"))
    lines.unionByName(frame).orderBy("part", "path").select("value").write.mode(mode).text(path)


RESULT_KIND = "none"
UNREADABLE, OTHER = "unreadable", "other"
#: Kinds of errors by how their messages begin.
ERROR_KINDS = {
    "missing_property": MISSING_PROPERTY.partition("{}")[0], "wrong_type": WRONG_TYPE.partition("{}")[0],
    "unsupported_type": UNSUPPORTED_TYPE.partition("{}")[0], "invalid_schema": INVALID_SCHEMA, "lost_answer": "Answer ",
}


def error_kind(status: Column, message: Column) -> Column:
    """What kind of error a message reports; a file that could not be read has but one kind."""
    kind = F.when(status == "failed", UNREADABLE)
    for name, start in ERROR_KINDS.items():
        kind = kind.when(F.startswith(message, F.lit(start)), name)
    return kind.otherwise(OTHER)


def error_rows(results: DataFrame, *keep: str) -> DataFrame:
    """One row per error: ``kind, error`` behind the columns to keep."""
    rows = results.select(*keep, "status", F.explode("errors").alias("error"))
    return rows.select(*keep, error_kind(F.col("status"), F.col("error")).alias("kind"), "error")


def write_with_quarantine(results: DataFrame, path: str, mode: str = "error") -> None:
    """Results and their errors in one pass: Parquet ``path, status, config, error`` partitioned by ``kind``.

    ``kind=none`` has one row per document with its configuration, every other
    folder the errors of one kind.
    """
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(RESULT_KIND).alias("kind"), F.to_json("config").alias("config"), none.alias("error"))
    errors = F.transform("errors", lambda e: F.struct(error_kind(F.col("status"), e).alias("kind"), none.alias("config"), e.alias("error")))
    rows = results.select("path", "status", F.explode(F.concat(F.array(own), errors)).alias("row"))
    rows.select("path", "status", "row.*").write.mode(mode).partitionBy("kind").parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The errors that :func:`write_with_quarantine` has written: ``path, status, kind, error``; other folders are not read."""
    return spark.read.parquet(path).where(F.col("kind") != RESULT_KIND).select("path", "status", "kind", "error")


def mask(value: Column, setting_type: Column, types=MASKED_TYPES) -> Column:
    """Hides the values of secret-bearing setting types."""
    return F.when(setting_type.isin(*types), F.lit("***")).otherwise(value)
