"""The content-hashed processing history and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import RELATED_LIMIT, SIMILARITY_SCORE
from ..functions.text import doc_hash

HISTORY_SCHEMA = T.StructType([
    T.StructField("doc_hash", T.StringType(), False),
    T.StructField("doc_path", T.StringType()),
    T.StructField("last_processed", T.TimestampType()),
    T.StructField("config_json", T.StringType()),
    T.StructField("metadata_json", T.StringType()),
])

EDGES_SCHEMA = T.StructType([
    T.StructField("source_hash", T.StringType()),
    T.StructField("target_hash", T.StringType()),
    T.StructField("relationship_type", T.StringType()),
    T.StructField("confidence", T.FloatType()),
])


def history_rows(docs: DataFrame) -> DataFrame:
    """History rows of processed documents ``(path, text, config_json, metadata_json, last_processed)``."""
    return docs.select(
        doc_hash(F.col("text")).alias("doc_hash"),
        F.col("path").alias("doc_path"),
        "last_processed", "config_json", "metadata_json",
    )


def upsert_history(history: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or replace by ``doc_hash``; the newest ``last_processed`` wins.

    At equal times an update beats a stored row, and among updates the larger
    ``seq`` column, if there is one, wins.  ``max_by`` combines before the
    shuffle, so a text with very many copies costs one row per task.
    """
    columns = HISTORY_SCHEMA.fieldNames()
    seq = F.col("seq") if "seq" in updates.columns else F.lit(0)
    both = history.select(*columns, F.lit(-1).cast("long").alias("seq")).unionByName(
        updates.select(*columns, seq.cast("long").alias("seq")))
    rest = F.struct(*columns[1:])
    # The path breaks remaining ties, so that a re-run picks the same row.
    newest = F.max_by(rest, F.struct("last_processed", "seq", "doc_path")).alias("row")
    return both.groupBy("doc_hash").agg(newest).select("doc_hash", "row.*")


def recent_contexts(history: DataFrame, k: int = RELATED_LIMIT) -> DataFrame:
    """One row holding the ``k + 1`` most recent history entries, newest first.

    Whatever single hash a document excludes, its ``k`` most recent others are
    among these, because hashes are unique.  Equal times are ordered by hash.
    """
    newest = history.select("last_processed", "doc_hash", "config_json", "metadata_json") \
        .orderBy(F.desc("last_processed"), "doc_hash").limit(k + 1)
    entry = F.struct(
        (-F.unix_micros("last_processed")).alias("age"), "doc_hash", "config_json", "metadata_json")
    return newest.agg(F.array_sort(F.collect_list(entry)).alias("recent"))


def related_contexts(docs: DataFrame, history: DataFrame, k: int = RELATED_LIMIT) -> DataFrame:
    """Adds ``related``: the ``k`` most recent contexts of other documents.

    The lookup is an uncorrelated scalar subquery over ``k + 1`` rows, so the
    documents are neither shuffled nor joined.
    """
    recent = recent_contexts(history, k).scalar()
    own = doc_hash(F.col("text")) if "doc_hash" not in docs.columns else F.col("doc_hash")
    with_recent = docs.withColumn("doc_hash", own).withColumn("recent", recent)
    return with_recent.select(
        *[c for c in docs.columns if c != "doc_hash"], "doc_hash",
        F.transform(
            F.slice(F.filter("recent", lambda r: r["doc_hash"] != F.col("doc_hash")), 1, k),
            lambda r: F.struct(
                r["config_json"].alias("config"),
                r["metadata_json"].alias("metadata"),
                F.lit(SIMILARITY_SCORE).alias("similarity_score"),
            ),
        ).alias("related"),
    )


def dangling_edges(edges: DataFrame, history: DataFrame) -> DataFrame:
    """Edges whose source or target hash is missing from the history.

    The distinct hashes the edges mention are checked once each (a left anti
    join on unique keys); only the missing ones meet the edges again.
    """
    mentioned = edges.select(F.explode(F.array("source_hash", "target_hash")).alias("doc_hash")).distinct()
    missing = mentioned.join(history.select("doc_hash"), "doc_hash", "left_anti")
    flagged = edges
    for end in ("source", "target"):
        marks = missing.select(F.col("doc_hash").alias(f"{end}_hash"), F.lit(True).alias(f"{end}_missing"))
        flagged = flagged.join(marks, f"{end}_hash", "left")
    absent = [F.coalesce(f"{end}_missing", F.lit(False)).alias(f"{end}_missing") for end in ("source", "target")]
    return flagged.select(*edges.columns, *absent).where("source_missing OR target_missing")
