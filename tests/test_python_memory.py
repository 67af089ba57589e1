"""What a Python worker holds at once is bounded, whatever a batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from catalog import queries
from configsieve.constants import CHUNK_SEPARATORS
from configsieve.functions import splitter
from configsieve.operators import assets
from configsieve.sources import files


def test_texts_are_cut_a_few_at_a_time(monkeypatch):
    texts = pa.array([None if n % 7 == 0 else f"{n} words, and more. " * (n % 5) for n in range(splitter.TEXTS_AT_ONCE * 2 + 3)])
    wanted = [None if t is None else splitter.split_text(t, 20, 5, CHUNK_SEPARATORS) for t in texts.to_pylist()]
    made, build = [], pa.array
    monkeypatch.setattr(splitter.pa, "array", lambda rows, kind: made.append(len(rows)) or build(rows, kind))
    assert splitter.chunk_lists(texts, 20, 5, CHUNK_SEPARATORS).to_pylist() == wanted
    assert made == [splitter.TEXTS_AT_ONCE] * 2 + [3]
    assert splitter.chunk_lists(texts[:0], 20, 5, CHUNK_SEPARATORS).to_pylist() == []


def test_chunks_of_more_texts_than_are_cut_at_once(spark):
    docs = spark.range(splitter.TEXTS_AT_ONCE * 3 + 1).coalesce(1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 5 != 0, F.concat(F.repeat(F.lit("some words. "), 4), F.col("id").cast("string"))).alias("text"))
    found = docs.select("text", splitter.recursive_chunks(F.col("text"), 20, 5).alias("chunks")).collect()
    assert [r.chunks for r in found] == [None if r.text is None else splitter.split_text(r.text, 20, 5, CHUNK_SEPARATORS) for r in found]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pictures_stay_in_arrow_up_to_their_header(spark):
    row = (1, "x.docx", "docx", queries.docx_bytes("text", "web", 77))
    frame = spark.createDataFrame([row, (2, "n.docx", "docx", None)], "doc_id long, path string, doc_type string, content binary")
    media = files.explode_docx_media(frame)
    assert "MapInArrow" in plan(media) and "MapInPandas" not in plan(media)
    assert [(r.path, r.place, r.format, r.width, r.height) for r in media.collect()] == [("x.docx", 0, "png", 77, 77)]
    assert files.explode_docx_media(frame.where("doc_id = 2")).count() == 0


def test_headers_of_no_picture_and_of_none(spark):
    rows = [(1, None), (2, b""), (3, b"no picture"), (4, b"GIF89a" + bytes([3, 0, 4, 0]))]
    sized = assets.with_picture_header(spark.createDataFrame(rows, "n long, content binary"))
    assert [tuple(r)[2:] for r in sized.orderBy("n").collect()] == [(None,) * 3] * 3 + [("gif", 3, 4)]
    assert assets.with_picture_header(sized.select("n", "content").where("n > 9")).count() == 0
