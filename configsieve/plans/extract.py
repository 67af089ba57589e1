"""From document texts to one validated configuration per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MIN_IMAGE_SIZE
from ..operators.assets import data_url, dedupe_assets, valid_assets
from ..operators.merge import merge_answers, merge_answers_and_pictures
from ..operators.requests import request_rows
from ..operators.validate import empty_variant, gate, validate
from ..sources.files import discover, explode_docx_media, read_documents
from .lineage import settled


def resolve_documents(docs: DataFrame, responses: DataFrame, schema: dict | None = None, rule: str = "A",
                      pictures: DataFrame | None = None) -> DataFrame:
    """Merge, validate and gate the answers of every document.

    ``docs``: ``doc_id, path, status, error``; ``responses``: ``doc_id,
    chunk_id, response``.  Returns ``doc_id, path, status, config, errors,
    unusable_answers, missing_answers``: a document that could not be read has a
    null ``config``, one without a usable or valid answer the schema's empty
    configuration.  Answers that are not JSON are skipped and counted, as are
    null ones; ``errors`` names those that spoil the document.  ``pictures``
    (``doc_id, chunk_id, response``) are answers on a document's pictures; they
    are merged under those on its text, by rule B throughout.
    """
    fragments = responses.select("doc_id", F.col("chunk_id").alias("ord"), "response")
    if pictures is None:
        merged = merge_answers(fragments, rule)
    else:
        merged = merge_answers_and_pictures(fragments, pictures.select("doc_id", F.col("chunk_id").alias("ord"), "response"))
    empty = empty_variant(schema)
    no_errors = F.array().cast("array<string>")
    # No filter on ``config``: Spark would build it a second time to test it.
    checked = gate(validate(merged, schema), schema) if schema else merged.withColumn("errors", no_errors)
    found = F.concat("problems", F.when(F.col("used"), F.col("errors")).otherwise(no_errors))
    checked = checked.select("doc_id", "config", found.alias("errors"), "unusable_answers", "missing_answers")
    ids = docs.select("doc_id", "path", "status", "error")
    joined = ids.join(checked, "doc_id", "left")
    readable = F.col("status") != "failed"
    return joined.select(
        "doc_id", "path", "status",
        F.when(readable, F.coalesce("config", empty)).alias("config"),
        F.coalesce("errors", F.when(~readable, F.array("error")), no_errors).alias("errors"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("unusable_answers", "missing_answers")),
    )


def process_directory(spark: SparkSession, directory: str, answer: Callable[[DataFrame], DataFrame],
                      history: DataFrame, schema: dict | None = None,
                      answer_pictures: Callable[[DataFrame], DataFrame] | None = None, **request_options) -> DataFrame:
    """Every supported file of a directory, answered by ``answer`` and resolved.

    ``answer`` maps request rows to ``doc_id, chunk_id, response``.  The path
    is the document id.  ``answer_pictures`` does the same for the rows of
    :func:`picture_requests`; their answers are merged under the others.  With
    ``spark.checkpoint.dir`` set, the parsed texts and the answers are written
    there once and read back.
    """
    docs = settled(read_documents(spark, directory).withColumn("doc_id", F.col("path")), "texts")
    readable = docs.where(F.col("status") != "failed").select("doc_id", "text")
    responses = settled(answer(request_rows(readable, history, schema, **request_options)), "answers")
    pictures = None
    if answer_pictures is not None:
        media = explode_docx_media(discover(spark, directory, only=["docx"]))
        pictures = settled(answer_pictures(picture_requests(media)), "picture-answers")
    return resolve_documents(docs, responses, schema, pictures=pictures)


def picture_requests(media: DataFrame, min_size: int = MIN_IMAGE_SIZE) -> DataFrame:
    """One request per picture worth one: ``doc_id, chunk_id, name, image_url``.

    Blank and small pictures drop out, and of equal ones, in one document or
    several, the first by path and name stays.  ``chunk_id`` is the picture's
    place in its document.
    """
    unique = dedupe_assets(valid_assets(media, min_size))
    return unique.select(F.col("path").alias("doc_id"), F.col("place").alias("chunk_id"), "name", data_url(F.col("content")).alias("image_url"))
