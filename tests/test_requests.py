"""Requests as whole messages and as documents plus chunks."""

from pyspark.sql import functions as F

from configsieve.operators import history, requests, sections

SCHEMA = {"type": "object"}


def tables(spark, repeats):
    text = "Configuration Settings:\nhost = abc\noption lang = en\n" * repeats
    docs = spark.createDataFrame([(1, text), (2, "timeout=30 " * 9)], "doc_id long, text string")
    stored = history.history_rows(docs.select(
        F.concat("text", F.lit("!")).alias("text"), F.lit("p").alias("path"), F.current_timestamp().alias("last_processed"),
        F.lit("{}").alias("config_json"), F.lit("{}").alias("metadata_json")))
    return docs, stored


def test_documents_and_chunks_make_the_same_requests(spark):
    docs, stored = tables(spark, 8)
    whole = requests.request_rows(docs, stored, SCHEMA, method="fixed", size=50, overlap=5)
    shared = requests.request_documents(docs, stored, method="fixed", size=50, overlap=5)
    cut = sections.chunk_documents(docs, "fixed", 50, 5).selectExpr("doc_id", "id AS chunk_id", "content AS text")
    rendered = requests.render_requests(shared, cut, SCHEMA)
    assert whole.count() > 4
    assert whole.exceptAll(rendered).count() == rendered.exceptAll(whole).count() == 0


def test_shared_parts_grow_with_the_text(spark):
    sizes = []
    for repeats in (50, 100, 200):
        docs, stored = tables(spark, repeats)
        shared = requests.request_documents(docs, stored, method="fixed", size=50, overlap=5).where("doc_id = 1")
        sizes.append(shared.select(F.length(F.concat("structure_summary", "related_configs", "relationships"))).first()[0])
    assert sizes[1] <= 2.2 * sizes[0] and sizes[2] <= 2.2 * sizes[1]
