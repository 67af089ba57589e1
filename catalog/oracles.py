"""DuckDB SQL for the registered queries, written without the library's logic.

Only the fixed values (patterns, word lists, prompt text) are shared.
"""

from __future__ import annotations

import json

from configsieve import constants as c

from .queries import (
    CONFIG_SCHEMA,
    EPOCH,
    REQUEST_OVERLAP,
    REQUEST_SIZE,
    SECTION_OVERLAP,
    SECTION_SIZE,
)
from .tables import derived_sql

# str.isspace() and Unicode digits in RE2 notation.
RE2_SPACE = (
    r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern as an SQL literal with explicit space and digit classes."""
    out, in_class, i = "", False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out += RE2_SPACE if in_class else f"[{RE2_SPACE}]"
        elif two == r"\d":
            out += r"\p{Nd}" if in_class else r"[\p{Nd}]"
        elif two[0] == "\\":
            out += two
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out += two[0]
            i -= 1
        i += 2
    return quoted(out)


def hits(docs: str, pattern: str, pattern_ord: int, name: str, key: str, value: str) -> str:
    """All matches of one pattern with their context; offsets from the pieces between matches."""
    p = re2(pattern)
    return f"""
SELECT doc_id, CAST({pattern_ord} AS INTEGER) AS pattern_ord, CAST(i - 1 AS INTEGER) AS match_ord,
  {quoted(name)} AS type, {key} AS key, {value} AS value, m[i] AS hit,
  substr(text, greatest(start_at - {c.CONTEXT_CHARS}, 0) + 1,
         least(start_at, {c.CONTEXT_CHARS}) + length(m[i]) + {c.CONTEXT_CHARS}) AS context
FROM (SELECT *, CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_at
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT doc_id, text, string_split_regex(text, {p}) AS s, regexp_extract_all(text, {p}) AS m,
        regexp_extract_all(text, {p}, 1) AS g1{", regexp_extract_all(text, " + p + ", 2) AS g2" if "g2" in value else ""}
      FROM {docs})))"""


def regex_hits(docs: str) -> str:
    parts = []
    for i, p in enumerate(c.SETTING_PATTERNS):
        key = "g1[i]" if p.groups == 2 else quoted(p.name)
        parts.append(hits(docs, p.regex, i, p.name, key, f"g{p.groups}[i]"))
    return "(" + " UNION ALL ".join(parts) + ")"


def word_list(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


KEEP = f"(lower(value) NOT IN {word_list(c.PLACEHOLDER_VALUES)} AND length(value) >= {c.MIN_VALUE_LENGTH})"


def settings_sql(docs: str, where: str = KEEP, context: bool = True) -> str:
    shown = ", context" if context else ""
    return f"SELECT doc_id, pattern_ord, match_ord, type, key, value{shown} FROM {regex_hits(docs)} WHERE {where}"


def block_hits(docs: str, pattern: str, pattern_ord: int, name: str) -> str:
    # A group is needed for the shared template; the whole block serves.
    wrapped = "(" + pattern + ")" if not pattern.startswith("(?m)") else "(?m)(" + pattern[4:] + ")"
    return hits(docs, wrapped, pattern_ord, name, "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")


JSON_ORD, YAML_ORD = len(c.SETTING_PATTERNS), len(c.SETTING_PATTERNS) + 1


def json_hits(docs: str) -> str:
    return f"(SELECT * FROM ({block_hits(docs, c.JSON_BLOCK, JSON_ORD, 'json_structure')}) WHERE json_valid(hit))"


def yaml_hits(docs: str) -> str:
    """Every block of the derived texts parses to a mapping."""
    return f"({block_hits(docs, c.YAML_BLOCK, YAML_ORD, 'yaml_structure')})"


def all_candidates(docs: str) -> str:
    return (f"(SELECT * FROM {regex_hits(docs)} WHERE {KEEP} UNION ALL SELECT * FROM {json_hits(docs)} "
            f"UNION ALL SELECT * FROM {yaml_hits(docs)})")


def summary_sql(docs: str, separator: str = ",") -> str:
    return f"""
SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS length,
  CAST(coalesce(n, 0) AS BIGINT) AS potential_config_count,
  {quoted(c.SUMMARY_SENTENCE)} AS document_summary, coalesce(types, '') AS config_patterns
FROM {docs} d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(type, '{separator}' ORDER BY pattern_ord, match_ord) AS types
  FROM {all_candidates(docs)} GROUP BY doc_id) a ON a.doc_id = d.doc_id"""


def chunks_sql(docs: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""(SELECT doc_id, CAST(start // {step} AS INTEGER) AS id, substr(text, start + 1, {size}) AS content
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - {overlap}, 1), {step})) AS start
  FROM {docs} WHERE length(text) > 0))"""


def recursive_chunks_sql(docs: str, size: int = c.CHUNK_SIZE, overlap: int = c.CHUNK_OVERLAP, separators=c.CHUNK_SEPARATORS) -> str:
    """The recursive splitter, level by level.

    `parts` cuts open pieces in front of the first separator they hold, until all
    are short or cannot be cut; `runs` are short neighbours from one cut; `packed`
    walks over a run from chunk to chunk, each beginning at the first piece from
    which on the tail is within the overlap and leaves room for the next piece.
    """
    marks = "[" + ", ".join("chr(10) || chr(10)" if s == "\n\n" else "chr(10)" if s == "\n" else quoted(s) for s in separators) + "]"
    last = len(separators)
    strip = f"'^[{RE2_SPACE}]+|[{RE2_SPACE}]+$'"
    return f"""(WITH RECURSIVE levels AS (SELECT {marks} AS marks),
parts AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS start, text AS piece, 1 AS level, 'open' AS kind, CAST(-1 AS BIGINT) AS parent FROM {docs} WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, start + before, piece, cut + 1, CASE WHEN length(piece) < {size} THEN 'short' WHEN cut < {last} THEN 'open' ELSE 'whole' END, start
  FROM (SELECT doc_id, start, cut, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, start, cut ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM (SELECT doc_id, start, cut, i, CASE WHEN i = 1 THEN pieces[i] ELSE mark || pieces[i] END AS piece
      FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i
        FROM (SELECT *, marks[cut] AS mark, string_split(piece, marks[cut]) AS pieces
          FROM (SELECT *, coalesce(list_min(list_filter(range(level, {last} + 1), lambda k: contains(piece, marks[k]))), {last}) AS cut
            FROM parts, levels WHERE kind = 'open'))))
    WHERE piece <> '')
),
runs AS (
  SELECT doc_id, parent, level, run, list(start ORDER BY start) AS starts, list(start + length(piece) ORDER BY start) AS ends
  FROM (SELECT *, count(*) FILTER (WHERE kind <> 'short') OVER (PARTITION BY doc_id, parent, level ORDER BY start) AS run FROM parts WHERE parent >= 0)
  WHERE kind = 'short' GROUP BY ALL
),
packed AS (
  SELECT doc_id, starts, ends, 1 AS first, list_min(list_filter(range(2, len(starts) + 1), lambda k: ends[k] - starts[1] > {size})) AS next FROM runs
  UNION ALL
  SELECT doc_id, starts, ends, first, list_min(list_filter(range(next + 1, len(starts) + 1), lambda k: ends[k] - starts[first] > {size}))
  FROM (SELECT doc_id, starts, ends, next, list_min(list_filter(range(first + 1, next + 1), lambda k:
          k = next OR (starts[next] - starts[k] <= {overlap} AND ends[next] - starts[k] <= {size}))) AS first
    FROM packed WHERE next IS NOT NULL)
),
cuts AS (
  SELECT doc_id, true AS stripped, starts[first] AS start, CASE WHEN next IS NULL THEN ends[len(ends)] ELSE starts[next] END AS stop FROM packed
  UNION ALL SELECT doc_id, false, start, start + length(piece) FROM parts WHERE kind = 'whole'
),
chunks AS (
  SELECT doc_id, start, CASE WHEN stripped THEN regexp_replace(cut, {strip}, '', 'g') ELSE cut END AS content
  FROM (SELECT doc_id, stripped, start, substr(text, start + 1, stop - start) AS cut FROM cuts JOIN {docs} USING (doc_id))
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS id, content FROM chunks WHERE content <> '')"""


def section_type_sql(column: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), {quoted(w)})" for w in words) + f" THEN {quoted(name)}"
        for name, words in c.SECTION_KEYWORDS)
    return f"CASE {cases} ELSE {quoted(c.DEFAULT_SECTION_TYPE)} END"


def heading_sql(column: str) -> str:
    strip = f"'^[{RE2_SPACE}]+|[{RE2_SPACE}]+$'"
    lines = f"list_transform(string_split({column}, chr(10))[1:3], lambda x: regexp_replace(x, {strip}, '', 'g'))"
    kept = f"list_filter({lines}, lambda x: length(x) < 100 AND x LIKE '%:')"
    return f"trim(({kept})[1], ':')"


def term_rows(chunks: str) -> str:
    terms = "[" + ", ".join(map(quoted, c.RELATION_TERMS)) + "]"
    return f"(SELECT doc_id, id, term FROM {chunks}, unnest({terms}) AS t(term) WHERE contains(lower(content), term))"


NOTES, CORPUS, ANSWERS = derived_sql("notes"), derived_sql("corpus"), derived_sql("answers")
PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages)"
EVENTS = "(SELECT event_id AS doc_id, props AS text FROM events)"
NOTE_CHUNKS = chunks_sql(NOTES, c.CHUNK_SIZE, c.CHUNK_OVERLAP)
SMALL_CHUNKS = chunks_sql(NOTES, SECTION_SIZE, SECTION_OVERLAP)
ASSIGNMENTS = " OR ".join(f"regexp_matches(content, {re2(p)})" for p in c.ASSIGNMENT_PATTERNS)


def stored(factor: int, prefix: str, seq: int) -> str:
    return f"""SELECT sha256(text) AS doc_hash, '{prefix}' || CAST(doc_id AS VARCHAR) AS doc_path,
  make_timestamp(({EPOCH} + doc_id * {factor} % 100003) * 1000000) AS last_processed,
  '{{"tenantId": "t' || CAST(doc_id AS VARCHAR) || '"}}' AS config_json,
  '{{"lang": "' || lang || '"}}' AS metadata_json, {seq} AS seq FROM documents"""


# Row numbers over all versions; upserting in two steps gives the same rows.
HISTORY = f"""(SELECT doc_hash, doc_path, last_processed, config_json, metadata_json FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY last_processed DESC, seq DESC, doc_path DESC) AS rn
  FROM ({stored(7919, "docs/", -1)} UNION ALL {stored(104729, "inbox/", 0)})) WHERE rn = 1)"""

RELATED = f"""(SELECT doc_id, CAST(rn - 1 AS INTEGER) AS rank, config_json AS config, metadata_json AS metadata,
  CAST(1.0 AS DOUBLE) AS similarity_score
FROM (SELECT d.doc_id, h.*, row_number() OVER (PARTITION BY d.doc_id ORDER BY h.last_processed DESC, h.doc_hash) AS rn
  FROM {{docs}} d, (SELECT * FROM {HISTORY} ORDER BY last_processed DESC, doc_hash LIMIT 4) h
  WHERE h.doc_hash <> sha256(d.text)) WHERE rn <= 3)"""


def dangling_sql() -> str:
    edges = "(SELECT sha256(text) AS source_hash, sha256(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '!' END) AS target_hash FROM documents)"
    known = f"(SELECT doc_hash FROM {HISTORY})"
    return f"""SELECT * FROM (SELECT source_hash, target_hash, 'reference' AS relationship_type,
  CAST(0.8 AS DOUBLE) AS confidence, source_hash NOT IN (SELECT doc_hash FROM {known}) AS source_missing,
  target_hash NOT IN (SELECT doc_hash FROM {known}) AS target_missing FROM {edges})
WHERE source_missing OR target_missing"""


def merge_string_sql(rule: str) -> str:
    source = derived_sql("fragments")
    if rule == "A":
        order = f"value IS NULL, lower(value) IN {word_list(c.MERGE_DEFAULTS)}, -length(value), ord"
        return f"""SELECT doc_id, path, value FROM (SELECT *, row_number() OVER (
  PARTITION BY doc_id, path ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"""
    loop = f"lower(value) IN {word_list(c.LOOPBACK_VALUES)}"
    # The first value stands unless it is a loopback name and a later one is not.
    return f"""SELECT doc_id, path, coalesce(arg_min(value, ord) FILTER (WHERE value IS NOT NULL AND NOT {loop}),
  arg_min(value, ord) FILTER (WHERE value IS NOT NULL)) AS value FROM {source} GROUP BY doc_id, path"""


def merge_sources_sql() -> str:
    """Rule B on pairs: (first, second) of the text, of the pictures, then of these two results."""
    loop = word_list(c.LOOPBACK_VALUES)

    def pair(a: str, b: str) -> str:
        # Values that begin with h stand for numbers, which neither yield nor take over.
        takes = f"lower({a}) IN {loop} AND {b} NOT LIKE 'h%' AND lower({b}) NOT IN {loop}"
        return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} WHEN {takes} THEN {b} ELSE {a} END"

    values = ", ".join(f"max(value) FILTER (WHERE ord = {k}) AS v{k}" for k in range(4))
    return f"""SELECT doc_id, path, CASE WHEN value IS NULL THEN 'null' WHEN value LIKE 'h%' THEN 'int' ELSE 'str' END AS vtype,
  CASE WHEN value LIKE 'h%' THEN substr(value, 2) ELSE value END AS value
FROM (SELECT doc_id, path, {pair("t", "p")} AS value FROM (SELECT doc_id, path, {pair("v0", "v1")} AS t, {pair("v2", "v3")} AS p
  FROM (SELECT doc_id, path, {values} FROM {derived_sql("fragments")} GROUP BY doc_id, path)))"""


# Leaves of the nested answers, path by path.  /server may be an object, a string or null.
FLAT = f"""(SELECT doc_id, chunk_id AS ord, json_extract_string(response, '$.tenantId') AS tenant,
  json_type(response, '$.server') AS kind, json_extract_string(response, '$.server') AS server,
  json_type(response, '$.server.host') AS host_kind, json_extract_string(response, '$.server.host') AS host,
  json_extract_string(response, '$.server.port') AS port,
  json_extract_string(response, '$.enableMonitoring') AS monitoring
FROM (SELECT * FROM {ANSWERS} WHERE json_valid(response)))"""


def nested_leaves(rule: str) -> str:
    """One winner per path of the nested answers, decided by window orders."""
    defaults = word_list(c.MERGE_DEFAULTS)
    loop = word_list(c.LOOPBACK_VALUES)
    if rule == "A":
        # /server: non-defaults first (a filled object is one), then fragment order.
        standing = f"CASE WHEN kind = 'OBJECT' THEN server = '{{}}' ELSE lower(server) IN {defaults} END"
        server_order = f"kind = 'NULL', {standing}, ord"
        text_order = f"value IS NULL, lower(value) IN {defaults}, -length(value), ord"
        port_order = "port IN ('0'), ord"
    else:
        server_order, port_order = "kind = 'NULL', ord", "ord"
        text_order = f"value IS NULL, lower(value) IN {loop}, ord"
    # Under rule B a leading loopback string yields to the first other string.
    takeover = f"""(SELECT doc_id, arg_min(server, ord) AS other FROM {FLAT}
      WHERE kind = 'VARCHAR' AND lower(server) NOT IN {loop} GROUP BY doc_id)"""
    longest = f"""(SELECT doc_id, server AS other FROM (SELECT doc_id, server, row_number() OVER (PARTITION BY doc_id
      ORDER BY lower(server) IN {defaults}, -length(server), ord) AS rn FROM {FLAT} WHERE kind = 'VARCHAR') WHERE rn = 1)"""
    yields = f"lower(server) IN {loop}" if rule == "B" else "true"
    return f"""(WITH flat AS {FLAT},
server AS (SELECT s.doc_id, CASE kind WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'null' ELSE 'str' END AS vtype,
    CASE kind WHEN 'OBJECT' THEN CASE WHEN filled THEN '{{...}}' ELSE '{{}}' END WHEN 'NULL' THEN NULL
      ELSE CASE WHEN {yields} THEN coalesce(other, server) ELSE server END END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {server_order}) AS rn,
      bool_or(kind = 'OBJECT' AND server <> '{{}}') OVER (PARTITION BY doc_id) AS filled FROM flat WHERE kind IS NOT NULL) s
  LEFT JOIN {takeover if rule == "B" else longest} t ON t.doc_id = s.doc_id WHERE rn = 1),
leaves AS (
  SELECT doc_id, ord, '/tenantId' AS path, 'str' AS vtype, tenant AS value FROM flat
  UNION ALL SELECT doc_id, ord, '/enableMonitoring', 'bool', monitoring FROM flat
  UNION ALL SELECT doc_id, ord, '/server/host', CASE host_kind WHEN 'NULL' THEN 'null' ELSE 'str' END, host
    FROM flat WHERE host_kind IS NOT NULL),
ports AS (SELECT doc_id, port AS value FROM (SELECT doc_id, port,
    row_number() OVER (PARTITION BY doc_id ORDER BY {port_order}) AS rn FROM flat WHERE port IS NOT NULL) WHERE rn = 1)
SELECT doc_id, '/server' AS path, vtype, value FROM server
UNION ALL SELECT doc_id, '/server/port', 'int', value FROM ports
  WHERE doc_id IN (SELECT doc_id FROM server WHERE vtype = 'dict')
UNION ALL SELECT doc_id, path, vtype, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path
    ORDER BY CASE WHEN path = '/enableMonitoring' THEN false ELSE value IS NULL END,
      {text_order.replace("value IS NULL, ", "", 1)}) AS rn FROM leaves) WHERE rn = 1
  AND (path NOT LIKE '/server/%' OR doc_id IN (SELECT doc_id FROM server WHERE vtype = 'dict')))"""


MERGED = f"""(SELECT doc_id, max(value) FILTER (WHERE path = '/tenantId') AS tenant,
  max(value) FILTER (WHERE path = '/enableMonitoring') AS monitoring,
  max(vtype) FILTER (WHERE path = '/server') AS server_type,
  max(CASE WHEN path = '/server' THEN CASE vtype WHEN 'null' THEN 'null' WHEN 'str' THEN '"' || value || '"' END END) AS server_value,
  max(CASE WHEN path = '/server/host' THEN CASE vtype WHEN 'null' THEN 'null' ELSE '"' || value || '"' END END) AS host,
  max(value) FILTER (WHERE path = '/server/port') AS port
FROM {nested_leaves("A")} GROUP BY doc_id)"""

SERVER_JSON = """CASE server_type WHEN 'dict' THEN '{' || coalesce('"host":' || host || ',"port":' || port, '') || '}'
  ELSE server_value END"""


def resolved_sql() -> str:
    errors = """concat_ws('; ',
  CASE WHEN server_type = 'dict' AND host = 'null' THEN 'Expected string at $.server.host, got NoneType' END,
  CASE WHEN server_type IN ('str', 'null') THEN 'Expected object at $.server, got ' || CASE server_type WHEN 'str' THEN 'str' ELSE 'NoneType' END END,
  CASE WHEN server_type IS NULL THEN 'Missing required property ''server'' at $' END)"""
    config = f"""'{{"enableMonitoring":' || monitoring || ',"server":' || ({SERVER_JSON}) || ',"tenantId":"' || tenant || '"}}'"""
    empty = """'{"enableMonitoring":false,"server":{},"tenantId":""}'"""
    return f"""(SELECT doc_id, path, status,
  CASE WHEN status = 'failed' THEN NULL WHEN errors = '' AND merged THEN config ELSE {empty} END AS config,
  CASE WHEN merged THEN errors WHEN status = 'failed' THEN 'unreadable' ELSE '' END AS errors
FROM (SELECT c_custkey AS doc_id, 'in/' || lower(c_name) AS path,
    CASE WHEN c_nationkey = 3 THEN 'failed' ELSE 'read' END AS status,
    m.doc_id IS NOT NULL AS merged, {errors} AS errors, {config} AS config
  FROM customer LEFT JOIN {MERGED} m ON m.doc_id = c_custkey))"""


def answer_problems_sql() -> str:
    """Every usable answer holds one key, so the first one wins; a deep one has its levels in the text's length."""
    return f"""SELECT doc_id, 'read' AS status,
  CASE WHEN deep THEN '{{}}' ELSE coalesce('{{' || CASE WHEN levels THEN '"a":' || nested || ',' ELSE '' END || coalesce('"k":"v' || least_k || '"', '') || '}}', '{{}}') END AS config,
  CASE WHEN deep THEN 'Answer 1: nested deeper than 1000 levels' ELSE '' END AS errors, unusable_answers, missing_answers
FROM (SELECT doc_id, coalesce(bool_or(length(response) > 6 * 1000 + 1), false) AS deep, coalesce(bool_or(length(response) = 6 * 1000 + 1), false) AS levels,
    repeat('{{"a":', 999) || '1' || repeat('}}', 999) AS nested, min(chunk_id) FILTER (WHERE response LIKE '{{"k":%') AS least_k,
    count(*) FILTER (WHERE response LIKE 'no %') AS unusable_answers, count(*) FILTER (WHERE response IS NULL) AS missing_answers
  FROM {derived_sql("odd_answers")} GROUP BY doc_id)"""


def request_sql(docs: str, size: int, overlap: int, relationships: str, columns: str) -> str:
    chunks = chunks_sql(docs, size, overlap)
    term_lists = ", ".join(
        f"""'"{t}": [' || coalesce(string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id)
          FILTER (WHERE contains(lower(content), '{t}')), '') || ']'""" for t in c.RELATION_TERMS)
    if relationships == "index":
        relation = f"SELECT doc_id, '{{' || concat_ws(', ', {term_lists}) || '}}' AS relationships FROM {chunks} GROUP BY doc_id"
    else:
        pair = """'{"source": ' || a.id || ', "target": ' || b.id || ', "type": "reference", "confidence": 0.8}'"""
        share = " OR ".join(f"(contains(lower(a.content), '{t}') AND contains(lower(b.content), '{t}'))" for t in c.RELATION_TERMS)
        relation = f"""SELECT a.doc_id, '[' || coalesce(string_agg({pair}, ', ' ORDER BY a.id, b.id) FILTER (WHERE b.id IS NOT NULL), '') || ']' AS relationships
          FROM {chunks} a LEFT JOIN {chunks} b ON a.doc_id = b.doc_id AND a.id <> b.id AND ({share}) GROUP BY a.doc_id"""
    slots = {
        "text": "content",
        "structure_summary": f"""'{{''length'': ' || length || ', ''potential_config_count'': ' || potential_config_count
          || ', ''document_summary'': ''' || document_summary || ''', ''config_patterns'': ['
          || CASE WHEN config_patterns = '' THEN '' ELSE '''' || replace(config_patterns, ',', ''', ''') || '''' END || ']}}'""",
        "related_configs": "related", "relationships": "relationships",
        "schema": quoted(json.dumps(CONFIG_SCHEMA, indent=2)),
    }
    message = quoted(c.USER_MESSAGE)
    for slot, sql in slots.items():
        message = message.replace("{" + slot + "}", f"' || ({sql}) || '")
    return f"""WITH docs AS MATERIALIZED (SELECT * FROM {docs}), summary AS ({summary_sql("docs")}),
related AS (SELECT doc_id, '[' || string_agg('{{"config": ' || config || ', "metadata": ' || metadata
    || ', "similarity_score": 1.0}}', ', ' ORDER BY rank) || ']' AS related FROM {RELATED.replace("{docs}", "docs")} GROUP BY doc_id),
relation AS ({relation.replace(docs, "docs")}), chunks AS {chunks.replace(docs, "docs")}
SELECT {columns} FROM (SELECT c.doc_id, c.id AS chunk_id, content, {message} AS message,
    ({slots["structure_summary"]}) AS structure_summary, related AS related_configs, relationships
  FROM chunks c JOIN summary s ON s.doc_id = c.doc_id JOIN related r ON r.doc_id = c.doc_id
  JOIN relation l ON l.doc_id = c.doc_id)"""


def validated(required: list[str]) -> str:
    """The seeded configurations with their sorted messages."""
    missing = " ".join(
        f"""UNION ALL SELECT cfg_id, 'Missing required property ''{p}'' at $' FROM configs
          WHERE json_type(config, '$.{p}') IS NULL""" for p in required)
    python = """CASE {kind} WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'NULL' THEN 'NoneType'
      WHEN 'VARCHAR' THEN 'str' WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'BOOLEAN' THEN 'bool' ELSE 'float' END"""

    def wrong(path, expected, kind):
        return f"""UNION ALL SELECT cfg_id, 'Expected {expected} at $.{path}, got ' || {python.format(kind="k")}
          FROM (SELECT cfg_id, json_type(config, '$.{path}') AS k FROM configs) WHERE k <> '{kind}'"""

    return f"""(WITH configs AS {derived_sql("configs")},
items AS (SELECT cfg_id, unnest(range(CAST(json_array_length(config, '$.interfacesInScope') AS BIGINT))) AS i, config
  FROM configs WHERE json_type(config, '$.interfacesInScope') = 'ARRAY'),
messages AS (SELECT cfg_id, 'Expected string at $.interfacesInScope[' || i || '], got ' || {python.format(kind="k")} AS message
    FROM (SELECT cfg_id, i, json_type(config, '$.interfacesInScope[' || i || ']') AS k FROM items) WHERE k <> 'VARCHAR'
  {missing} {wrong("tenantId", "string", "VARCHAR")} {wrong("enableMonitoring", "boolean", "BOOLEAN")}
  {wrong("interfacesInScope", "array", "ARRAY")})
SELECT c.cfg_id, count(message) = 0 AS is_valid, coalesce(string_agg(message, '; ' ORDER BY message), '') AS errors, any_value(c.config) AS config
FROM configs c LEFT JOIN messages m ON m.cfg_id = c.cfg_id GROUP BY c.cfg_id)"""


def typed_rows_sql() -> str:
    port = r"""CASE json_type(row, '$.port') WHEN 'BOOLEAN' THEN NULL ELSE
      CASE WHEN regexp_full_match(json_extract_string(row, '$.port'), '[0-9]+(\.0*)?') THEN
        CAST(CAST(json_extract_string(row, '$.port') AS DOUBLE) AS BIGINT) ELSE -1 END END"""
    return f"""SELECT row_id, concat_ws('; ',
  CASE WHEN json_exists(row, '$.schema') THEN 'extra:schema' END,
  CASE WHEN port > 65535 OR port = 0 THEN 'range:port' END,
  CASE WHEN json_type(row, '$.host') NOT IN ('VARCHAR', 'NULL') THEN 'type:host' END,
  CASE WHEN port = -1 THEN 'type:port' END) AS violations
FROM (SELECT *, {port} AS port FROM {derived_sql("database_rows")})"""


PNG = """(SELECT *, unhex('89504E470D0A1A0A0000000D49484452' || lpad(printf('%X', n_chars % 120), 8, '0')
  || lpad(printf('%X', n_chars % 120), 8, '0')) || encode(text) AS content FROM documents)"""


def oracle_sql() -> dict[str, str]:
    documents = "documents"
    return {
        "settings_extract": settings_sql(CORPUS, context=False),
        "settings_context": settings_sql(CORPUS),
        "settings_notes": settings_sql(NOTES),
        "settings_pages": settings_sql(PAGES),
        "false_positives": settings_sql(CORPUS, f"NOT {KEEP}", False),
        "first_pass_summary": summary_sql(CORPUS),
        "first_pass_summary_notes": summary_sql(NOTES),
        "json_settings": f"""SELECT doc_id, match_ord, type, context, json_extract_string(hit, '$.tenantId') AS "tenantId",
            CAST(json_extract_string(hit, '$.enableMonitoring') AS BOOLEAN) AS "enableMonitoring" FROM {json_hits(CORPUS)}""",
        "json_event_props": f"""SELECT doc_id, match_ord, type, context,
            CAST(json_extract_string(hit, '$.k') AS BIGINT) AS k FROM {json_hits(EVENTS)}""",
        "yaml_settings": f"""SELECT doc_id, match_ord, type, context, regexp_extract(hit, 'ip: (\\S+)', 1) AS ip,
            CAST(regexp_extract(hit, 'uptime: (\\S+)', 1) AS BIGINT) AS uptime FROM {yaml_hits(CORPUS)}""",
        "candidates": f"""SELECT doc_id, pattern_ord, match_ord, type, key, value, context,
            pattern_ord >= {JSON_ORD} AS structured FROM {all_candidates(CORPUS)}""",
        "chunks_fixed": f"SELECT * FROM {chunks_sql(documents, c.CHUNK_SIZE, c.CHUNK_OVERLAP)}",
        "chunks_recursive": f"SELECT * FROM {recursive_chunks_sql(documents)}",
        "sections_recursive": f"""SELECT doc_id, id, {section_type_sql('content')} AS type, {heading_sql('content')} AS heading, content,
            CAST(length(content) AS INTEGER) AS length FROM {recursive_chunks_sql(NOTES)}""",
        "section_types": f"SELECT doc_id, id, {section_type_sql('content')} AS type FROM {NOTE_CHUNKS}",
        "section_headings": f"""SELECT doc_id, id, {heading_sql('content')} AS heading,
            CAST(length(content) AS INTEGER) AS length FROM {NOTE_CHUNKS}""",
        "config_sections": f"""SELECT doc_id, id, type, heading, length FROM (SELECT *, {section_type_sql('content')} AS type,
            {heading_sql('content')} AS heading, CAST(length(content) AS INTEGER) AS length
            FROM {chunks_sql(NOTES, REQUEST_SIZE, REQUEST_OVERLAP)}) WHERE type = 'configuration' OR {ASSIGNMENTS}""",
        "section_terms": f"SELECT doc_id, id, term FROM {term_rows(SMALL_CHUNKS)}",
        "section_relationships": f"""WITH t AS {term_rows(SMALL_CHUNKS)} SELECT DISTINCT a.doc_id, a.id AS source, b.id AS target,
            'reference' AS type, CAST(0.8 AS DOUBLE) AS confidence FROM t a JOIN t b
            ON a.doc_id = b.doc_id AND a.term = b.term AND a.id <> b.id""",
        "doc_hashes": "SELECT doc_id, sha256(text) AS doc_hash FROM documents",
        "history_store": f"SELECT * FROM {HISTORY}",
        "result_rows": f"SELECT path, coalesce(config, 'null') AS config FROM {resolved_sql()}",
        "result_map": f"SELECT path, coalesce(config, 'null') AS config FROM {resolved_sql()}",
        "files_read": """SELECT source, 'text' AS doc_type, 'read' AS status, CAST(NULL AS VARCHAR) AS error,
            CAST(length(t) AS INTEGER) AS length, md5(t) AS text_md5
            FROM (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)""",
        "history_upsert": f"SELECT * FROM {HISTORY}",
        "related_contexts": f"SELECT * FROM {RELATED.replace('{docs}', 'documents')}",
        "dangling_edges": dangling_sql(),
        "merge_rule_a": merge_string_sql("A"),
        "merge_rule_b": merge_string_sql("B"),
        "merge_sources_b": merge_sources_sql(),
        "merge_nested_a": f"SELECT doc_id, path, vtype, value FROM {nested_leaves('A')}",
        "merge_nested_b": f"SELECT doc_id, path, vtype, value FROM {nested_leaves('B')}",
        "merge_configs": f"SELECT doc_id, tenant, CAST(monitoring AS BOOLEAN) AS monitoring, {SERVER_JSON} AS server FROM {MERGED}",
        "request_rows": request_sql(
            NOTES, REQUEST_SIZE, REQUEST_OVERLAP, "index",
            f"""doc_id, chunk_id, CAST(length(content) AS INTEGER) AS text_length,
            md5({quoted(c.SYSTEM_MESSAGE)}) AS system_md5, md5(message) AS user_md5"""),
        "request_documents": request_sql(
            NOTES, REQUEST_SIZE, REQUEST_OVERLAP, "index",
            """DISTINCT doc_id, md5(structure_summary) AS structure_summary, md5(related_configs) AS related_configs,
            md5(relationships) AS relationships"""),
        "request_rows_pairs": request_sql(
            CORPUS, SECTION_SIZE, SECTION_OVERLAP, "pairs", "doc_id, chunk_id, md5(message) AS user_md5"),
        "attach_responses": f"""SELECT k.doc_id, k.id AS chunk_id, response, coalesce(json_valid(response), false) AS parsed,
            CASE WHEN json_valid(response) THEN json_extract_string(response, '$.tenantId') END AS tenant
            FROM {chunks_sql(CORPUS, SECTION_SIZE, SECTION_OVERLAP)} k
            LEFT JOIN {ANSWERS} a ON a.doc_id = k.doc_id AND a.chunk_id = k.id""",
        "resolved_configs": f"SELECT * FROM {resolved_sql()}",
        "processing_summary": f"""SELECT count(*) AS total_files, count(config) AS successful_files,
            count(*) - count(config) AS failed_files,
            (SELECT count(*) FILTER (WHERE NOT json_valid(response)) FROM {ANSWERS}) AS unusable_answers,
            (SELECT count(*) FILTER (WHERE response IS NULL) FROM {ANSWERS}) AS missing_answers FROM {resolved_sql()}""",
        "quarantine": f"""SELECT doc_id, CASE WHEN status = 'failed' THEN 'unreadable' WHEN error LIKE 'Missing%' THEN 'missing_property'
              WHEN error LIKE 'Expected%' THEN 'wrong_type' ELSE 'other' END AS kind, error
            FROM (SELECT doc_id, status, unnest(string_split(errors, '; ')) AS error FROM {resolved_sql()}) WHERE error <> ''""",
        "answer_problems": answer_problems_sql(),
        "validate_config": f"SELECT cfg_id, is_valid, errors FROM {validated(['tenantId', 'enableMonitoring', 'userId'])}",
        "validate_loaded_schema": f"SELECT cfg_id, is_valid, errors FROM {validated(['tenantId', 'enableMonitoring', 'userId'])}",
        "validate_config_odd_schema": f"""SELECT cfg_id, false AS is_valid, concat_ws('; ', 'Invalid schema at $.port: schema must be an object',
            CASE WHEN json_type(config, '$.tenantId') IS NULL THEN 'Missing required property ''tenantId'' at $' END,
            CASE WHEN json_type(config, '$.tenantId') IS NOT NULL THEN 'Unsupported type ''[''string'', ''null'']'' at $.tenantId' END,
            'Unsupported type ''flag'' at $.enableMonitoring') AS errors,
            '{{"tenantId":null}}' AS config
          FROM {derived_sql("configs")}""",
        "empty_config_gate": f"""SELECT cfg_id, is_valid, CASE WHEN is_valid THEN
            '{{"enableMonitoring":true,"interfacesInScope":["a","b"],"port":' || json_extract_string(config, '$.port')
            || ',"tenantId":"' || json_extract_string(config, '$.tenantId') || '"}}'
            ELSE '{{"enableMonitoring":false,"tenantId":""}}' END AS config FROM {validated(['tenantId', 'enableMonitoring'])}""",
        "typed_rows": typed_rows_sql(),
        "server_rows": """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'type:$' WHEN event_id % 4 = 0 THEN 'type:uptime'
            ELSE '' END AS violations FROM events""",
        "document_types": """SELECT doc_id, source || '/' || name AS path, doc_type FROM (SELECT *,
            ['a.PDF', 'b.docx', 'c.doc', 'd.txt', 'e.json', 'f.yml', 'g.mkv', 'h.m4a', 'i.exe', 'pdf'][doc_id % 10 + 1] AS name,
            ['pdf', 'docx', 'docx', 'text', 'json', 'yaml', 'video', 'audio', NULL, NULL][doc_id % 10 + 1] AS doc_type FROM documents)""",
        "asset_dedupe": f"""SELECT path, name, md5, bytes FROM (SELECT source || '.pdf' AS path,
            'a' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, md5(content) AS md5,
            CAST(octet_length(content) AS INTEGER) AS bytes,
            row_number() OVER (PARTITION BY md5(content) ORDER BY source || '.pdf', doc_id) AS rn FROM {PNG}) WHERE rn = 1""",
        "asset_fields": f"""SELECT doc_id, 'pdf_p' || (doc_id % 7) || '_img_' || md5(content)[1:8] || '.'
            || ['jpg', 'png', 'jp2', 'tiff', 'png'][doc_id % 5 + 1] AS pdf_name,
            'docx_img_' || md5(content)[1:8] || '.jpeg' AS docx_name,
            md5('{c.DATA_URL_PREFIX}' || base64(content)) AS url_md5 FROM {PNG}""",
        "asset_filter": f"""SELECT doc_id, 'png' AS format, CAST(n_chars % 120 AS INTEGER) AS width,
            CAST(n_chars % 120 AS INTEGER) AS height FROM {PNG} WHERE n_chars % 120 >= 50""",
        "visible_assets": """SELECT doc_id, 'png' AS format, CAST(n_chars % 120 AS INTEGER) AS width,
            CAST(n_chars % 120 AS INTEGER) AS height FROM documents WHERE n_chars % 120 >= 50 AND doc_id % 3 <> 0""",
        # The marker must lie within the first 2048 bytes, which the varying prefix decides.
        "sniff_format": """SELECT doc_id, CAST(doc_id AS VARCHAR) || '.doc' AS path,
            CASE WHEN doc_id % 17 = 0 THEN 'doc' WHEN doc_id % 3 = 0 THEN 'zip'
              WHEN doc_id % 3 = 1 AND doc_id % 2 = 0
                AND 8 + octet_length(encode(substr(text, 1, 1900 + doc_id % 200))) + 14 <= 2048 THEN 'doc'
              ELSE 'other' END AS format FROM documents""",
        "docx_text": """SELECT path, 'read' AS status, CAST(length(t) AS INTEGER) AS length, md5(t) AS text_md5
            FROM (SELECT CAST(doc_id AS VARCHAR) || '.docx' AS path,
              array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))
              || CASE WHEN trim(replace(text, chr(10), '')) = '' THEN '' ELSE chr(10) END
              || source || ' | ' || CAST(n_chars AS VARCHAR) AS t FROM documents)""",
        "docx_media": f"""SELECT CAST(doc_id AS VARCHAR) || '.docx' AS path, 'word/media/image1.png' AS member,
            'docx_img_' || md5(content)[1:8] || '.png' AS name, 'png' AS format, CAST(n_chars % 120 AS INTEGER) AS width,
            CAST(n_chars % 120 AS INTEGER) AS height, CAST(octet_length(content) AS INTEGER) AS bytes FROM {PNG}""",
    }
