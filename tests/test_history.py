"""History upsert, lookups and the table directories."""

import os
import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from configsieve.operators import history
from configsieve.sinks import history as tables

START = datetime(2024, 1, 1)
SCHEMA = history.HISTORY_SCHEMA


def row(h, minute, path="p", config="{}"):
    return (h, path, START + timedelta(minutes=minute), config, '{"n": 1}')


def test_newest_wins(spark):
    stored = spark.createDataFrame([row("a", 1, "old"), row("b", 9, "kept"), row("c", 5, "tie")], SCHEMA)
    updates = spark.createDataFrame([row("a", 2, "new"), row("b", 3, "late"), row("c", 5, "update"), row("d", 0)], SCHEMA)
    found = {r["doc_hash"]: r["doc_path"] for r in history.upsert_history(stored, updates).collect()}
    assert found == {"a": "new", "b": "kept", "c": "update", "d": "p"}


def test_sequence_decides_equal_times(spark):
    updates = spark.createDataFrame([row("a", 1, f"u{i}") + (i,) for i in (2, 7, 5)], StructType([*SCHEMA.fields, StructField("seq", LongType())]))
    found = history.upsert_history(spark.createDataFrame([], tables.HISTORY_SCHEMA), updates)
    assert [r["doc_path"] for r in found.collect()] == ["u7"]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_related_contexts(spark, k):
    texts = [f"text {i}" for i in range(20)]
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    rows = [row(h, i // 2, config=f'{{"i": {i}}}') for i, h in enumerate(hashes)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["unseen"])], "doc_id long, text string")
    related = history.related_contexts(docs, spark.createDataFrame(rows, tables.HISTORY_SCHEMA), k)
    for r in related.collect():
        others = [x for x in rows if x[0] != r["doc_hash"]]
        wanted = sorted(others, key=lambda x: (START - x[2], x[0]))[:k]
        assert [c["config"] for c in r["related"]] == [x[3] for x in wanted]
        assert all(c["similarity_score"] == 1.0 for c in r["related"])


def test_related_contexts_of_an_empty_history(spark):
    docs = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    (found,) = history.related_contexts(docs, spark.createDataFrame([], tables.HISTORY_SCHEMA)).collect()
    assert found["related"] == []


def test_related_contexts_neither_joins_nor_shuffles_documents(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    frame = history.related_contexts(docs, spark.createDataFrame([row("a", 1)], tables.HISTORY_SCHEMA))
    main = frame._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main


def test_dangling_edges(spark):
    edges = spark.createDataFrame(
        [("a", "b", "r", 0.8), ("a", "x", "r", 0.8), ("y", "x", "r", 0.5), (None, "b", "r", 0.1)], history.EDGES_SCHEMA)
    known = spark.createDataFrame([row("a", 1), row("b", 1)], tables.HISTORY_SCHEMA)
    found = history.dangling_edges(edges, known)
    assert {(r["source_hash"], r["target_hash"], r["source_missing"], r["target_missing"]) for r in found.collect()} == {
        ("a", "x", False, True), ("y", "x", True, True)}


def test_tables(spark, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        tables.read_history(spark, base)
    tables.create_tables(spark, base)
    tables.create_tables(spark, base)
    assert tables.read_history(spark, base).count() == 0 and tables.read_edges(spark, base).count() == 0
    frame = lambda *rows: spark.createDataFrame(list(rows), tables.HISTORY_SCHEMA)
    tables.store_contexts(spark, base, frame(row("a", 1, "one"), row("b", 1, "one")))
    tables.store_contexts(spark, base, frame(row("a", 1, "two")))
    paths = lambda: {r["doc_hash"]: r["doc_path"] for r in tables.read_history(spark, base).collect()}
    assert paths() == {"a": "two", "b": "one"}
    compacted = tables.compact_history(spark, base)
    assert tables.compact_history(spark, base) == compacted
    assert paths() == {"a": "two", "b": "one"}
    tables.store_contexts(spark, base, frame(row("c", 0, "three")))
    assert paths() == {"a": "two", "b": "one", "c": "three"}
    # A write that did not get as far as its entry does not count.
    lost = tables.store_contexts(spark, base, frame(row("d", 0, "lost")))
    assert "d" in paths()
    for part in (tmp_path / f"store/history/log/entry={lost}").glob("*.json"):
        part.unlink()
    assert "d" not in paths()


def test_any_path_that_spark_writes(spark, tmp_path, monkeypatch):
    """A relative path, and a store that only Spark's file systems know."""
    monkeypatch.chdir(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.history.link./at", f"file://{tmp_path}")
    there = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    for base in (os.path.relpath(tmp_path, there) + "/near", "viewfs://history/at/far"):
        tables.create_tables(spark, base)
        tables.store_contexts(spark, base, spark.createDataFrame([row("a", 1, "one")], tables.HISTORY_SCHEMA))
        tables.compact_history(spark, base)
        tables.store_contexts(spark, base, spark.createDataFrame([row("b", 1, "two")], tables.HISTORY_SCHEMA))
        assert {r["doc_hash"] for r in tables.read_history(spark, base).collect()} == {"a", "b"}
    assert (tmp_path / "near/history").is_dir() and (tmp_path / "far/history").is_dir()


def test_stores_from_the_same_state_are_both_kept(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/store"
    tables.create_tables(spark, base)
    frame = lambda *rows: spark.createDataFrame(list(rows), tables.HISTORY_SCHEMA)
    version, _ = tables._state(spark, base)
    tables.store_contexts(spark, base, frame(row("a", 1, "one")))
    # A compaction that has looked before the second store, and ends after it.
    seen = tables._state(spark, base)
    tables.store_contexts(spark, base, frame(row("b", 1, "two")))
    monkeypatch.setattr(tables, "_state", lambda *_: seen)
    tables.compact_history(spark, base)
    monkeypatch.undo()
    assert {r["doc_hash"] for r in tables.read_history(spark, base).collect()} == {"a", "b"}


def test_rows_without_a_time_were_processed_now(spark, tmp_path):
    base = str(tmp_path / "store")
    tables.create_tables(spark, base)
    tables.store_contexts(spark, base, spark.createDataFrame([row("a", 1)], tables.HISTORY_SCHEMA).drop("last_processed"))
    (found,) = tables.read_history(spark, base).collect()
    assert found["last_processed"].year >= 2024
