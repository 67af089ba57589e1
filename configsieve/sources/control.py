"""Small control inputs and answer tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_schema(path: str, root: str | None = None, spark: SparkSession | None = None):
    """A JSON schema from a file; ``root`` names the member that holds it, if wrapped.

    The file is a local one, or with ``spark`` any that Spark reads.
    """
    try:
        if spark is None:
            with open(path, encoding="utf-8") as file:
                text = file.read()
        else:
            text = "\n".join(r.value for r in spark.read.text(path).collect())
        schema = json.loads(text)
        return schema if root is None else schema[root]
    except (OSError, ValueError, KeyError, TypeError, AnalysisException) as error:
        raise ValueError(f"Invalid schema file: {error}") from error


def load_responses(responses: DataFrame) -> DataFrame:
    """Per-chunk answers in the fixed shape ``doc_id, chunk_id INT, response STRING``."""
    return responses.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"),
                            F.col("response").cast("string").alias("response"))
