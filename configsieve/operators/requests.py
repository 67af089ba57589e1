"""Second-pass request rows and the answers that come back for them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    RELATED_LIMIT,
    RELATION_CONFIDENCE,
    RELATION_TERMS,
    RELATION_TYPE,
    SYSTEM_MESSAGE,
    USER_MESSAGE,
)
from .history import related_contexts
from .sections import chunks
from .settings import first_pass_summary


def request_rows(docs: DataFrame, history: DataFrame, schema: dict | None = None, *,
                 method: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 relationships: str = "index", k: int = RELATED_LIMIT,
                 system: str = SYSTEM_MESSAGE, template: str = USER_MESSAGE) -> DataFrame:
    """One request per chunk: ``doc_id, chunk_id, text, system_message, user_message``.

    The document-level slots are computed while a document is still one row,
    and the chunks are exploded last: no join and no shuffle.

    ``relationships='index'`` lists per term the sections holding it, which
    says the same as the list of all related pairs in linear space;
    ``'pairs'`` spells the pairs out (quadratic in the sections of a document).
    """
    prepared = _documents(docs, history, method, size, overlap, relationships, k)
    # The outer form, because for the inner one Spark infers a filter on the size of
    # the array and cuts every text again to evaluate it.
    rows = prepared.select("*", F.posexplode_outer("chunks").alias("chunk_id", "text")).drop("chunks")
    return rows.where(F.col("chunk_id").isNotNull()).select(
        "doc_id", "chunk_id", "text",
        F.lit(system).alias("system_message"),
        fill_template(template, json.dumps(schema or {}, indent=2)).alias("user_message"),
    )


def request_documents(docs: DataFrame, history: DataFrame, *, method: str = "recursive", size: int = CHUNK_SIZE,
                      overlap: int = CHUNK_OVERLAP, k: int = RELATED_LIMIT) -> DataFrame:
    """What all requests of a document share, once per document: ``doc_id, structure_summary, related_configs, relationships``.

    Together with the chunks this is linear in the text, where whole messages
    repeat the shared part for every chunk.  :func:`render_requests` joins the
    two where requests are sent.
    """
    return _documents(docs, history, method, size, overlap, "index", k).drop("chunks")


def render_requests(documents: DataFrame, chunk_rows: DataFrame, schema: dict | None = None, *,
                    system: str = SYSTEM_MESSAGE, template: str = USER_MESSAGE) -> DataFrame:
    """Request rows from :func:`request_documents` and chunks ``doc_id, chunk_id, text``."""
    return chunk_rows.join(documents, "doc_id").select(
        "doc_id", "chunk_id", "text", F.lit(system).alias("system_message"),
        fill_template(template, json.dumps(schema or {}, indent=2)).alias("user_message"))


def _documents(docs: DataFrame, history: DataFrame, method: str, size: int, overlap: int, relationships: str, k: int) -> DataFrame:
    """One row per document: its chunks and the slots its requests share."""
    if relationships not in ("index", "pairs"):
        raise ValueError(f"unknown relationships form: {relationships}")
    cut = docs.select("doc_id", "text", chunks(F.col("text"), method, size, overlap).alias("chunks"))
    summarised = first_pass_summary(cut, keep=("doc_id", "text", "chunks"))
    related = related_contexts(summarised, history, k)
    relation_slot = relation_index if relationships == "index" else relation_pairs
    return related.select(
        "doc_id", "chunks",
        summary_text().alias("structure_summary"),
        related_text(F.col("related")).alias("related_configs"),
        relation_slot(F.col("chunks")).alias("relationships"),
    )


def fill_template(template: str, schema_text: str) -> Column:
    """The template with its ``{slot}`` parts replaced by columns of the same name."""
    parts, rest = [], template
    while rest:
        literal, brace, rest = rest.partition("{")
        if literal:
            parts.append(F.lit(literal))
        if brace:
            slot, _, rest = rest.partition("}")
            parts.append(F.lit(schema_text) if slot == "schema" else F.col(slot))
    return F.concat(*parts)


def summary_text() -> Column:
    """The first-pass summary columns in the notation of a Python dict."""
    types = F.transform("config_patterns", lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    return F.concat(
        F.lit("{'length': "), F.col("length").cast("string"),
        F.lit(", 'potential_config_count': "), F.col("potential_config_count").cast("string"),
        F.lit(", 'document_summary': '"), F.col("document_summary"),
        F.lit("', 'config_patterns': ["), F.array_join(types, ", "), F.lit("]}"),
    )


def related_text(related: Column) -> Column:
    """Related contexts as a JSON list; config and metadata already are JSON texts."""
    entries = F.transform(related, lambda r: F.concat(
        F.lit('{"config": '), r["config"], F.lit(', "metadata": '), r["metadata"],
        F.lit(', "similarity_score": '), r["similarity_score"].cast("string"), F.lit("}"),
    ))
    return F.concat(F.lit("["), F.array_join(entries, ", "), F.lit("]"))


def relation_index(contents: Column, terms: Sequence[str] = RELATION_TERMS) -> Column:
    """``{"term": [section ids], ...}``: sections are related when they share a list."""
    lists = [
        F.concat(F.lit(json.dumps(term) + ": ["), F.array_join(_holders(contents, term), ", "), F.lit("]"))
        for term in terms
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *lists), F.lit("}"))


def relation_pairs(contents: Column, terms: Sequence[str] = RELATION_TERMS) -> Column:
    """The related pairs as a JSON list of ``source, target, type, confidence``."""
    holders = [_holders(contents, term) for term in terms]
    targets = lambda i: F.array_sort(F.array_distinct(F.concat(*[
        F.when(F.array_contains(ids, i), F.array_remove(ids, i)).otherwise(F.array().cast("array<int>"))
        for ids in holders])))
    ids = F.sequence(F.lit(0), F.size(contents) - 1)
    pairs = F.flatten(F.transform(
        F.when(F.size(contents) > 0, ids).otherwise(F.array().cast("array<int>")),
        lambda i: F.transform(targets(i), lambda j: F.concat(
            F.lit('{"source": '), i.cast("string"), F.lit(', "target": '), j.cast("string"),
            F.lit(f', "type": "{RELATION_TYPE}", "confidence": {RELATION_CONFIDENCE}}}'),
        )),
    ))
    return F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))


def attach_responses(chunk_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds ``response`` and its parsed ``config`` (null if missing or not JSON).

    The key ``(doc_id, chunk_id)`` is unique on both sides, so no value of it is hot.
    """
    joined = chunk_rows.join(responses.select("doc_id", "chunk_id", "response"), ["doc_id", "chunk_id"], "left")
    return joined.withColumn("config", F.try_parse_json("response"))


def _holders(contents: Column, term: str) -> Column:
    """Ids of the sections whose content holds ``term``."""
    marked = F.transform(contents, lambda c, i: F.when(F.contains(F.lower(c), F.lit(term)), i))
    return F.array_compact(marked)
