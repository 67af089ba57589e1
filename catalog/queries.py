"""The registered queries: every operator over whole tables and whole texts."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from configsieve.functions.text import doc_hash, heading, section_type
from configsieve.operators import assets, history, merge, requests, sections, settings, summary, validate
from configsieve.plans.extract import resolve_documents
from configsieve.plans.lineage import shared_folder
from configsieve.sinks import history as store
from configsieve.sinks import results
from configsieve.sources.control import load_responses, load_schema
from configsieve.sources.files import doc_type, explode_docx_media, read_documents, read_docx

from .tables import base, derived

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC

CONFIG_SCHEMA = {
    "type": "object",
    "required": ["tenantId", "enableMonitoring", "userId"],
    "properties": {
        "tenantId": {"type": "string"},
        "enableMonitoring": {"type": "boolean"},
        "interfacesInScope": {"type": "array", "items": {"type": "string"}},
        "port": {"type": "integer"},
    },
}
ANSWER_SCHEMA = {
    "type": "object",
    "required": ["tenantId", "enableMonitoring", "server"],
    "properties": {
        "tenantId": {"type": "string"},
        "enableMonitoring": {"type": "boolean"},
        "server": {"type": "object", "properties": {"host": {"type": "string"}, "port": {"type": "integer"}}},
    },
}
ODD_SCHEMA = {
    "type": "object",
    "required": ["tenantId"],
    "properties": {
        "tenantId": {"type": ["string", "null"]},
        "enableMonitoring": {"type": "flag"},
        "interfacesInScope": {"items": {"type": "string"}},
        "port": "integer",
    },
}
SECTION_SIZE, SECTION_OVERLAP = 120, 20
REQUEST_SIZE, REQUEST_OVERLAP = 500, 50
DOCX_AT_ONCE = 256


# --- settings ---------------------------------------------------------------

def settings_extract(spark, sf_dir):
    found = settings.extract_settings(derived(spark, sf_dir, "corpus"), context=False)
    return settings.drop_false_positives(found).drop("context")


def settings_context(spark, sf_dir):
    return settings.drop_false_positives(settings.extract_settings(derived(spark, sf_dir, "corpus")))


def settings_notes(spark, sf_dir):
    return settings.drop_false_positives(settings.extract_settings(derived(spark, sf_dir, "notes")))


def settings_pages(spark, sf_dir):
    pages = base(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return settings.drop_false_positives(settings.extract_settings(pages))


def false_positives(spark, sf_dir):
    found = settings.extract_settings(derived(spark, sf_dir, "corpus"), context=False).drop("context")
    return found.where(~settings.is_real_value(F.col("value")))


def first_pass_summary(spark, sf_dir):
    return _summary(derived(spark, sf_dir, "corpus"))


def first_pass_summary_notes(spark, sf_dir):
    return _summary(derived(spark, sf_dir, "notes"))


def _summary(docs):
    types = F.array_join("config_patterns", ",").alias("config_patterns")
    return settings.first_pass_summary(docs).select(
        "doc_id", "length", "potential_config_count", "document_summary", types)


def json_settings(spark, sf_dir):
    found = settings.extract_json(derived(spark, sf_dir, "corpus"))
    return found.select("doc_id", "match_ord", "type", "context", *_members(tenantId="string", enableMonitoring="boolean"))


def json_event_props(spark, sf_dir):
    events = base(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return settings.extract_json(events).select("doc_id", "match_ord", "type", "context", *_members(k="long"))


def yaml_settings(spark, sf_dir):
    found = settings.extract_yaml(derived(spark, sf_dir, "corpus"))
    return found.select(
        "doc_id", "match_ord", "type", "context",
        F.variant_get("value_json", "$.server.ip", "string").alias("ip"),
        F.variant_get("value_json", "$.server.uptime", "long").alias("uptime"))


def candidates(spark, sf_dir):
    found = settings.extract_candidates(derived(spark, sf_dir, "corpus"))
    return found.select(
        "doc_id", "pattern_ord", "match_ord", "type", "key", "value", "context",
        F.col("value_json").isNotNull().alias("structured"))


def _members(**types) -> list[Column]:
    return [F.variant_get("value_json", f"$.{name}", kind).alias(name) for name, kind in types.items()]


# --- sections ---------------------------------------------------------------

def chunks_fixed(spark, sf_dir):
    return sections.chunk_documents(base(spark, sf_dir, "documents"), "fixed")


def chunks_recursive(spark, sf_dir):
    return sections.chunk_documents(base(spark, sf_dir, "documents"), "recursive")


def section_types(spark, sf_dir):
    cut = sections.chunk_documents(derived(spark, sf_dir, "notes"), "fixed")
    return cut.select("doc_id", "id", section_type(F.col("content")).alias("type"))


def section_headings(spark, sf_dir):
    cut = sections.chunk_documents(derived(spark, sf_dir, "notes"), "fixed")
    return cut.select("doc_id", "id", heading(F.col("content")).alias("heading"), F.length("content").alias("length"))


def config_sections(spark, sf_dir):
    found = sections.identify_sections(derived(spark, sf_dir, "notes"), "fixed", REQUEST_SIZE, REQUEST_OVERLAP)
    return sections.config_sections(found).select("doc_id", "id", "type", "heading", "length")


def sections_recursive(spark, sf_dir):
    return sections.identify_sections(derived(spark, sf_dir, "notes"))


def section_terms(spark, sf_dir):
    return sections.section_terms(_small_sections(spark, sf_dir))


def section_relationships(spark, sf_dir):
    return sections.relate_sections(_small_sections(spark, sf_dir))


def _small_sections(spark, sf_dir):
    return sections.chunk_documents(derived(spark, sf_dir, "notes"), "fixed", SECTION_SIZE, SECTION_OVERLAP)


# --- history ----------------------------------------------------------------

def _stored(spark, sf_dir, factor: int, prefix: str):
    docs = base(spark, sf_dir, "documents")
    return history.history_rows(docs.select(
        "text",
        F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_seconds(EPOCH + F.col("doc_id") * factor % 100003).alias("last_processed"),
        F.concat(F.lit('{"tenantId": "t'), F.col("doc_id").cast("string"), F.lit('"}')).alias("config_json"),
        F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}')).alias("metadata_json"),
    ))


def _history(spark, sf_dir):
    stored = _stored(spark, sf_dir, 7919, "docs/")
    return history.upsert_history(stored, _stored(spark, sf_dir, 104729, "inbox/"))


def doc_hashes(spark, sf_dir):
    return base(spark, sf_dir, "documents").select("doc_id", doc_hash(F.col("text")).alias("doc_hash"))


def history_upsert(spark, sf_dir):
    return _history(spark, sf_dir)


def history_store(spark, sf_dir):
    """Two stores with a compaction between them, written and read back."""
    place = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    store.create_tables(spark, place)
    store.store_contexts(spark, place, _stored(spark, sf_dir, 7919, "docs/"))
    store.compact_history(spark, place)
    store.store_contexts(spark, place, _stored(spark, sf_dir, 104729, "inbox/"))
    return store.read_history(spark, place)


def related_contexts(spark, sf_dir):
    docs = base(spark, sf_dir, "documents").select("doc_id", "text")
    related = history.related_contexts(docs, _history(spark, sf_dir))
    ranked = related.select("doc_id", F.posexplode("related").alias("rank", "context"))
    return ranked.select("doc_id", "rank", "context.*")


def dangling_edges(spark, sf_dir):
    docs = base(spark, sf_dir, "documents")
    edges = docs.select(
        doc_hash(F.col("text")).alias("source_hash"),
        doc_hash(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise("!"))).alias("target_hash"),
        F.lit("reference").alias("relationship_type"), F.lit(0.8).cast("float").alias("confidence"))
    return history.dangling_edges(edges, _history(spark, sf_dir)) \
        .withColumn("confidence", F.round(F.col("confidence").cast("double"), 3))


# --- merge ------------------------------------------------------------------

def merge_rule_a(spark, sf_dir):
    return merge.merge_leaves(_string_leaves(spark, sf_dir), "A").select("doc_id", "path", "value")


def merge_rule_b(spark, sf_dir):
    return merge.merge_leaves(_string_leaves(spark, sf_dir), "B").select("doc_id", "path", "value")


def merge_sources_b(spark, sf_dir):
    """The first two leaves of a path as the text's, the others as the pictures'; names with h are numbers."""
    leaves = _string_leaves(spark, sf_dir)
    number = F.col("value").startswith("h")
    leaves = leaves.withColumn("vtype", F.when(number, "int").otherwise(F.col("vtype"))) \
        .withColumn("value", F.when(number, F.substring("value", 2, 9)).otherwise(F.col("value")))
    sources = [leaves.where(F.col("ord") < 2), leaves.where(F.col("ord") >= 2)]
    return merge.merge_sources(sources, "B").select("doc_id", "path", "vtype", "value")


def merge_nested_a(spark, sf_dir):
    return _nested_leaves(spark, sf_dir, "A")


def merge_nested_b(spark, sf_dir):
    return _nested_leaves(spark, sf_dir, "B")


def merge_configs(spark, sf_dir):
    merged = merge.merge_fragments(_answers(spark, sf_dir))
    return merged.select(
        "doc_id",
        F.variant_get("config", "$.tenantId", "string").alias("tenant"),
        F.variant_get("config", "$.enableMonitoring", "boolean").alias("monitoring"),
        F.to_json(F.variant_get("config", "$.server", "variant")).alias("server"))


def _string_leaves(spark, sf_dir):
    vtype = F.when(F.col("value").isNull(), merge.NULL).otherwise(merge.STRING)
    return derived(spark, sf_dir, "fragments").withColumn("vtype", vtype)


def _answers(spark, sf_dir):
    return load_responses(derived(spark, sf_dir, "answers")).withColumnRenamed("chunk_id", "ord")


def _nested_leaves(spark, sf_dir, rule):
    leaves = merge.merge_leaves(merge.flatten_fragments(_answers(spark, sf_dir)), rule)
    return merge.drop_shadowed(leaves).where(F.col("path") != "").select("doc_id", "path", "vtype", "value")


# --- requests, results ------------------------------------------------------

def request_rows(spark, sf_dir):
    docs = derived(spark, sf_dir, "notes")
    rows = requests.request_rows(docs, _history(spark, sf_dir), CONFIG_SCHEMA, method="fixed",
                                 size=REQUEST_SIZE, overlap=REQUEST_OVERLAP)
    return rows.select("doc_id", "chunk_id", F.length("text").alias("text_length"),
                       F.md5("system_message").alias("system_md5"), F.md5("user_message").alias("user_md5"))


def request_documents(spark, sf_dir):
    rows = requests.request_documents(derived(spark, sf_dir, "notes"), _history(spark, sf_dir), method="fixed",
                                      size=REQUEST_SIZE, overlap=REQUEST_OVERLAP)
    return rows.select("doc_id", *(F.md5(c).alias(c) for c in ("structure_summary", "related_configs", "relationships")))


def request_rows_pairs(spark, sf_dir):
    rows = requests.request_rows(derived(spark, sf_dir, "corpus"), _history(spark, sf_dir), CONFIG_SCHEMA,
                                 method="fixed", size=SECTION_SIZE, overlap=SECTION_OVERLAP, relationships="pairs")
    return rows.select("doc_id", "chunk_id", F.md5("user_message").alias("user_md5"))


def attach_responses(spark, sf_dir):
    cut = sections.chunk_documents(derived(spark, sf_dir, "corpus"), "fixed", SECTION_SIZE, SECTION_OVERLAP)
    joined = requests.attach_responses(
        cut.withColumnRenamed("id", "chunk_id"), load_responses(derived(spark, sf_dir, "answers")))
    return joined.select(
        "doc_id", "chunk_id", "response", F.col("config").isNotNull().alias("parsed"),
        F.variant_get("config", "$.tenantId", "string").alias("tenant"))


def _results(spark, sf_dir):
    customers = base(spark, sf_dir, "customer")
    docs = customers.select(
        F.col("c_custkey").alias("doc_id"), F.concat(F.lit("in/"), F.lower("c_name")).alias("path"),
        F.when(F.col("c_nationkey") == 3, "failed").otherwise("read").alias("status"),
        F.when(F.col("c_nationkey") == 3, "unreadable").alias("error"))
    return resolve_documents(docs, load_responses(derived(spark, sf_dir, "answers")), ANSWER_SCHEMA)


def resolved_configs(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "doc_id", "path", "status", F.to_json("config").alias("config"), F.array_join("errors", "; ").alias("errors"))


def answer_problems(spark, sf_dir):
    """Answers that are deep, missing or no JSON, and what becomes of their documents."""
    customers = base(spark, sf_dir, "customer")
    docs = customers.select(
        F.col("c_custkey").alias("doc_id"), F.lower("c_name").alias("path"), F.lit("read").alias("status"), F.lit(None).cast("string").alias("error"))
    return resolve_documents(docs, load_responses(derived(spark, sf_dir, "odd_answers"))).select(
        "doc_id", "status", F.to_json("config").alias("config"), F.array_join("errors", "; ").alias("errors"), "unusable_answers", "missing_answers")


def processing_summary(spark, sf_dir):
    return summary.processing_summary(_results(spark, sf_dir))


def quarantine(spark, sf_dir):
    return results.error_rows(_results(spark, sf_dir), "doc_id")


def result_rows(spark, sf_dir):
    """Results written as JSON lines and read back."""
    place = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    results.write_results(_results(spark, sf_dir), place)
    return spark.read.schema("path string, config variant").json(place).select("path", F.to_json("config").alias("config"))


def result_map(spark, sf_dir):
    """Results written as one JSON object in parts, and its members read back."""
    place = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    results.write_result_map(_results(spark, sf_dir), place)
    lines = spark.read.text(place).where(~F.col("value").isin("{", "}"))
    member = F.parse_json(F.concat(F.lit("{"), F.substring("value", 3, 2**31 - 1), F.lit("}")))
    name = F.get(F.json_object_keys(F.to_json(member)), F.lit(0))
    return lines.select(name.alias("path"), F.regexp_extract("value", r'^..".*?": (.*)$', 1).alias("config"))


# --- validation -------------------------------------------------------------

def _validated(spark, sf_dir):
    configs = derived(spark, sf_dir, "configs").select("cfg_id", F.try_parse_json("config").alias("config"))
    return validate.validate(configs, CONFIG_SCHEMA)


def validate_config(spark, sf_dir):
    return _validated(spark, sf_dir).select("cfg_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


def validate_loaded_schema(spark, sf_dir):
    """The configurations against a schema read from a file, below a member of it."""
    place = f"{shared_folder(spark)}/schema-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"configSchema": CONFIG_SCHEMA}),)], "value string").write.text(place)
    configs = derived(spark, sf_dir, "configs").select("cfg_id", F.try_parse_json("config").alias("config"))
    checked = validate.validate(configs, load_schema(place, "configSchema", spark))
    return checked.select("cfg_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


def validate_config_odd_schema(spark, sf_dir):
    configs = derived(spark, sf_dir, "configs").select("cfg_id", F.try_parse_json("config").alias("config"))
    checked = validate.validate(configs, ODD_SCHEMA)
    gated = validate.gate(checked, ODD_SCHEMA)
    return gated.select("cfg_id", "is_valid", F.array_join("errors", "; ").alias("errors"), F.to_json("config").alias("config"))


def empty_config_gate(spark, sf_dir):
    relaxed = CONFIG_SCHEMA | {"required": ["tenantId", "enableMonitoring"]}
    configs = derived(spark, sf_dir, "configs").select("cfg_id", F.try_parse_json("config").alias("config"))
    gated = validate.gate(validate.validate(configs, relaxed), relaxed)
    return gated.select("cfg_id", "is_valid", F.to_json("config").alias("config"))


def typed_rows(spark, sf_dir):
    checked = validate.check_database_rows(derived(spark, sf_dir, "database_rows"))
    return checked.select("row_id", F.array_join("violations", "; ").alias("violations"))


def server_rows(spark, sf_dir):
    props = base(spark, sf_dir, "events").select("event_id", server_row_json().alias("row"))
    return validate.check_server_rows(props).select("event_id", F.array_join("violations", "; ").alias("violations"))


def server_row_json() -> Column:
    uptime = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")) \
        .otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    ends = F.when(F.col("event_id") % 9 == 0, F.lit("]")).otherwise(F.lit("}"))
    return F.concat(F.lit('{"ip": "10.0.0.'), F.col("user_id").cast("string"), F.lit('", "uptime": '), uptime, ends)


def document_types(spark, sf_dir):
    names = F.array(*[F.lit(e) for e in ("a.PDF", "b.docx", "c.doc", "d.txt", "e.json", "f.yml", "g.mkv", "h.m4a", "i.exe", "pdf")])
    path = F.concat("source", F.lit("/"), F.get(names, (F.col("doc_id") % 10).cast("int")))
    return base(spark, sf_dir, "documents").select("doc_id", path.alias("path"), doc_type(path).alias("doc_type"))


# --- assets and files -------------------------------------------------------

def _assets(spark, sf_dir):
    """Documents as PNG-like assets: a header with a size, then the text as pixels."""
    side = F.lpad(F.hex(F.col("n_chars") % 120), 8, "0")
    header = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side, side)
    content = F.concat(F.unhex(header), F.col("text").cast("binary"))
    filters = F.array(*[F.lit(f) for f in ("/DCTDecode", "/FlateDecode", "/JPXDecode", "/CCITTFaxDecode", "/Other")])
    return base(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("path"),
        F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"),
        content.alias("content"), F.col("doc_id"),
        F.get(filters, (F.col("doc_id") % 5).cast("int")).alias("filter"))


def asset_dedupe(spark, sf_dir):
    return assets.dedupe_assets(_assets(spark, sf_dir).select("path", "name", "content")) \
        .select("path", "name", "md5", F.length("content").alias("bytes"))


def asset_fields(spark, sf_dir):
    content = F.col("content")
    return _assets(spark, sf_dir).select(
        "doc_id",
        assets.pdf_asset_name(F.col("doc_id") % 7, content, F.col("filter")).alias("pdf_name"),
        assets.docx_asset_name(content, F.lit("JPEG")).alias("docx_name"),
        F.md5(assets.data_url(content)).alias("url_md5"))


def asset_filter(spark, sf_dir):
    sized = assets.with_picture_header(_assets(spark, sf_dir).select("doc_id", "content"))
    return sized.where(assets.is_valid_asset(F.col("width"), F.col("height"))).select("doc_id", "format", "width", "height")


def _pictures(spark, sf_dir):
    """Each document as a square PNG of black dots; two thirds have one dot that is not black."""

    def draw(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [png_bytes(*row) for row in zip(batch["doc_id"], batch["n_chars"])]})

    return base(spark, sf_dir, "documents").select("doc_id", "n_chars").mapInPandas(draw, "doc_id long, content binary")


def png_bytes(doc_id: int, n_chars: int) -> bytes:
    side = n_chars % 120
    rows = [bytearray(1 + side) for _ in range(side)]
    if doc_id % 3 and side:
        rows[n_chars * 7 % side][1 + doc_id % side] = 1 + doc_id % 255
    header = struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)
    parts = ((b"IHDR", header), (b"IDAT", zlib.compress(b"".join(rows), 1)), (b"IEND", b""))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunk(*part) for part in parts)


def visible_assets(spark, sf_dir):
    sized = assets.with_picture_header(_pictures(spark, sf_dir))
    return assets.valid_assets(sized).select("doc_id", "format", "width", "height")


def sniff_format(spark, sf_dir):
    magic = F.array(F.lit(b"PK\x03\x04"), F.lit(bytes.fromhex("D0CF11E0A1B11AE1")), F.lit(b""))
    marker = F.when(F.col("doc_id") % 2 == 0, F.lit(b"Word.Document.8")).otherwise(F.lit(b""))
    content = F.concat(F.get(magic, (F.col("doc_id") % 3).cast("int")), F.substring("text", 1, 1900 + F.col("doc_id") % 200)
                       .cast("binary"), marker, F.col("text").cast("binary"))
    files = base(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".doc")).alias("path"),
        F.when(F.col("doc_id") % 17 != 0, content).alias("content"))
    return assets.sniff_format(files).select("doc_id", "path", "format")


def files_read(spark, sf_dir):
    """The documents of each source as one text file, found and read back."""
    place = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = base(spark, sf_dir, "documents").select("source", "doc_id", "text")
    dealt = docs.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id")
    dealt.write.partitionBy("source").text(place)
    return read_documents(spark, place).select(
        F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "doc_type", "status", "error",
        F.length("text").alias("length"), F.md5("text").alias("text_md5"))


def _docx_files(spark, sf_dir):
    """Each document as a DOCX: lines as paragraphs, a table, the text's bytes as a picture."""

    def pack(batches):
        some = (batch[lo:lo + DOCX_AT_ONCE] for batch in batches for lo in range(0, len(batch), DOCX_AT_ONCE))
        for batch in some:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "path": [f"{i}.docx" for i in batch["doc_id"]], "doc_type": "docx",
                "content": [docx_bytes(t, s, n) for t, s, n in zip(batch["text"], batch["source"], batch["n_chars"])],
            })

    return base(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars").mapInPandas(
        pack, "doc_id long, path string, doc_type string, content binary")


def docx_bytes(text: str, source: str, n_chars: int) -> bytes:
    paragraph = '<w:p><w:r><w:t xml:space="preserve">{}</w:t></w:r></w:p>'
    cell = "<w:tc>" + paragraph + "</w:tc>"
    body = "".join(paragraph.format(escape(line)) for line in text.split("\n"))
    table = "<w:tr>" + "".join(cell.format(escape(c)) for c in (f" {source} ", "", str(n_chars))) + "</w:tr>"
    namespace = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{namespace}"><w:body>{body}<w:tbl>{table}</w:tbl></w:body></w:document>'
    side = (n_chars % 120).to_bytes(4, "big")
    picture = b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR" + side + side + text.encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("word/document.xml", xml)
        archive.writestr("word/media/image1.png", picture)
    return packed.getvalue()


def docx_text(spark, sf_dir):
    read = read_docx(_docx_files(spark, sf_dir))
    return read.select("path", "status", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


def docx_media(spark, sf_dir):
    media = explode_docx_media(_docx_files(spark, sf_dir))
    return media.select("path", "member", "name", "format", "width", "height", F.length("content").alias("bytes"))


QUERIES = {f.__name__: f for f in (
    settings_extract, settings_context, settings_notes, settings_pages, false_positives,
    first_pass_summary, first_pass_summary_notes, json_settings, json_event_props, yaml_settings, candidates,
    chunks_fixed, chunks_recursive, section_types, section_headings, config_sections, sections_recursive,
    section_terms, section_relationships,
    doc_hashes, history_upsert, history_store, related_contexts, dangling_edges,
    merge_rule_a, merge_rule_b, merge_sources_b, merge_nested_a, merge_nested_b, merge_configs,
    request_rows, request_documents, request_rows_pairs, attach_responses, resolved_configs, answer_problems, processing_summary, quarantine, result_rows, result_map,
    validate_config, validate_loaded_schema, validate_config_odd_schema, empty_config_gate, typed_rows, server_rows, document_types,
    files_read, asset_dedupe, asset_fields, asset_filter, visible_assets, sniff_format, docx_text, docx_media,
)}
