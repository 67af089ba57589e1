"""The history and edges tables as Parquet directories.

``<base>/history/batch=<name>`` holds the rows of one store and
``version=<name>`` a full table.  ``<base>/history/log/entry=<name>`` has one row
per finished write: its kind, its name and, for a version, the batches that are
in it.  Names begin with the time and end with a random part, so two writers
never meet and nothing is overwritten.  Storing appends a batch and costs what
the batch costs; reading resolves the batches that the newest version does not
include by the newest-wins rule; compacting writes another version.

A write counts once its entry is there.  An entry is a single file that appears
under its name when it is complete, so a job that dies half-way leaves the
previous state in force, and a batch that ends after a compaction began is
simply not included yet.  Everything is read and written by Spark's own sources:
any path that Spark writes will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.history import EDGES_SCHEMA, HISTORY_SCHEMA, upsert_history

HISTORY, EDGES = "history", "edges"
BATCH, VERSION = "batch", "version"
ENTRY = "kind string, name string, included array<string>"
SCHEMAS = {HISTORY: HISTORY_SCHEMA, EDGES: EDGES_SCHEMA}


def create_tables(spark: SparkSession, base: str) -> None:
    """Write empty first versions of both tables unless they exist."""
    for table, schema in SCHEMAS.items():
        if not any(entry.kind == VERSION for entry in _log(spark, base, table)):
            _write(spark.createDataFrame([], schema), base, table, VERSION, [])


def read_history(spark: SparkSession, base: str) -> DataFrame:
    """The current history, one row per ``doc_hash``."""
    version, batches = _state(spark, base)
    stored = spark.read.schema(HISTORY_SCHEMA).parquet(_path(base, HISTORY, VERSION, version.name))
    if not batches:
        return stored
    # The place of a batch in the order of names decides between rows of equal time.
    recent = [spark.read.schema(HISTORY_SCHEMA).parquet(_path(base, HISTORY, BATCH, name)).withColumn("seq", F.lit(k))
              for k, name in enumerate(batches)]
    updates = recent[0]
    for more in recent[1:]:
        updates = updates.unionByName(more)
    return upsert_history(stored, updates)


def read_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edges table."""
    return spark.read.schema(EDGES_SCHEMA).parquet(_path(base, EDGES, VERSION, _versions(spark, base, EDGES)[-1].name))


def store_contexts(spark: SparkSession, base: str, updates: DataFrame) -> str:
    """Insert or replace history rows; returns the name of the batch written.

    Rows without ``last_processed`` were processed now.
    """
    _versions(spark, base, HISTORY)
    known = updates if "last_processed" in updates.columns else updates.withColumn("last_processed", F.lit(None).cast("timestamp"))
    rows = known.withColumn("last_processed", F.coalesce("last_processed", F.current_timestamp()))
    return _write(rows.select(*HISTORY_SCHEMA.fieldNames()), base, HISTORY, BATCH, [])


def compact_history(spark: SparkSession, base: str) -> str:
    """Fold all finished batches into a new version, if there are any; returns the newest version's name."""
    version, batches = _state(spark, base)
    if not batches:
        return version.name
    return _write(read_history(spark, base), base, HISTORY, VERSION, [*version.included, *batches])


def _write(rows: DataFrame, base: str, table: str, kind: str, included: list[str]) -> str:
    """The rows first, then the entry that makes them count."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(_path(base, table, kind, name))
    entry = rows.sparkSession.createDataFrame([(kind, name, included)], ENTRY)
    entry.coalesce(1).write.mode("errorifexists").json(f"{_log_path(base, table)}/entry={name}")
    return name


def _log(spark: SparkSession, base: str, table: str) -> list[Row]:
    """The finished writes, in order of their names: a small row for each store."""
    try:
        found = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(_log_path(base, table))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((entry for entry in found.collect() if entry.name), key=lambda entry: entry.name)


def _versions(spark: SparkSession, base: str, table: str) -> list[Row]:
    versions = [entry for entry in _log(spark, base, table) if entry.kind == VERSION]
    if not versions:
        raise FileNotFoundError(f"no {table} table under {base}")
    return versions


def _state(spark: SparkSession, base: str) -> tuple[Row, list[str]]:
    """The newest version and the finished batches it does not include, in order."""
    newest = _versions(spark, base, HISTORY)[-1]
    included = set(newest.included)
    return newest, [entry.name for entry in _log(spark, base, HISTORY) if entry.kind == BATCH and entry.name not in included]


def _path(base: str, table: str, kind: str, name: str) -> str:
    return f"{base.rstrip('/')}/{table}/{kind}={name}"


def _log_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}/log"
