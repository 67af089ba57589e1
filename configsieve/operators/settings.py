"""Candidate settings of a text: regex hits, JSON blocks and YAML blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CONTEXT_CHARS,
    JSON_BLOCK,
    MIN_VALUE_LENGTH,
    PLACEHOLDER_VALUES,
    SETTING_PATTERNS,
    SUMMARY_SENTENCE,
    SettingPattern,
)
from ..functions.regex import (
    check_pattern,
    find_all,
    find_all_in_context,
    folded,
    may_match,
    pad_char,
    padded,
    to_java,
)
from ..functions.yaml_blocks import BLOCKS_TYPE, yaml_blocks

JSON_TYPE = "json_structure"
YAML_TYPE = "yaml_structure"
TO_THE_END = 2**31 - 1
DIGITS = "0123456789"
JSON_PATTERN = SettingPattern(JSON_TYPE, JSON_BLOCK, 0, "{")

SETTINGS_SCHEMA = "doc_id {id}, pattern_ord int, match_ord int, type string, key string, value string, context string"


def extract_settings(docs: DataFrame, patterns: Sequence[SettingPattern] = SETTING_PATTERNS,
                     context: bool = True, width: int = CONTEXT_CHARS, engine: str = "native") -> DataFrame:
    """One row per match of each pattern: ``doc_id, pattern_ord, match_ord, type, key, value, context``.

    ``(pattern_ord, match_ord)`` is the order within a document.  Narrow: no
    shuffle, one regex scan per pattern and text.  ``engine='arrow'`` runs
    Python's ``re`` over Arrow batches instead and takes any pattern.
    """
    if engine == "arrow":
        return _extract_with_python(docs, patterns, context, width)
    for pattern in patterns:
        check_pattern(pattern.regex)
    parts = [_regex_part(i, p, context, width) for i, p in enumerate(patterns)]
    hits = _located(docs, parts, context, width, scanned=_scanned(patterns))
    read = _read_once(_per_type(patterns, _key).alias("key"), _per_type(patterns, _value).alias("value"))
    return hits.select("doc_id", "pattern_ord", "match_ord", "type", read, "context")


def extract_json(docs: DataFrame, width: int = CONTEXT_CHARS) -> DataFrame:
    """One row per brace group that parses as JSON, with the object as VARIANT."""
    hits = _located(docs, [(0, JSON_TYPE, _finder(JSON_PATTERN, True, width))], True, width)
    value = F.try_parse_json(F.regexp_extract("hit", JSON_BLOCK, 0))
    return hits.select(
        "doc_id", "match_ord", "type", _read_once(value.alias("value_json")), "context",
    ).where(F.col("value_json").isNotNull())


def extract_yaml(docs: DataFrame, width: int = CONTEXT_CHARS) -> DataFrame:
    """One row per indented block under a ``name:`` line that parses to a mapping.

    ``value_json`` is null where the mapping has no JSON form (it contains itself).
    """
    blocks = docs.select("doc_id", F.posexplode(yaml_blocks(F.col("text"), width)).alias("match_ord", "block"))
    return blocks.select(
        "doc_id", "match_ord", F.lit(YAML_TYPE).alias("type"),
        F.try_parse_json("block.json").alias("value_json"), F.col("block.context").alias("context"),
    )


def extract_candidates(docs: DataFrame, patterns: Sequence[SettingPattern] = SETTING_PATTERNS,
                       context: bool = True, width: int = CONTEXT_CHARS) -> DataFrame:
    """All candidates, false positives dropped, from a single read of the texts.

    Regex hits fill ``key`` and ``value``; JSON and YAML blocks fill
    ``value_json``.  They follow the regex hits in ``pattern_ord``.
    """
    json_ord, yaml_ord = len(patterns), len(patterns) + 1
    for pattern in patterns:
        check_pattern(pattern.regex)
    parts = [_regex_part(i, p, context, width) for i, p in enumerate(patterns)]
    parts.append((json_ord, JSON_TYPE, _finder(JSON_PATTERN, context, width)))
    with_yaml = docs.select("doc_id", "text", yaml_blocks(F.col("text"), width).alias("yaml"))
    hits = _located(with_yaml, parts, context, width, yaml_ord, _scanned(patterns))
    json_text = F.when(F.col("type") == JSON_TYPE, F.regexp_extract("hit", JSON_BLOCK, 0)) \
        .when(F.col("type") == YAML_TYPE, F.col("block_json"))
    read = _read_once(
        _per_type(patterns, _key).alias("key"),
        _per_type(patterns, _value).alias("value"),
        F.try_parse_json(json_text).alias("value_json"),
    )
    rows = hits.select("doc_id", "pattern_ord", "match_ord", "type", read, "context")
    return drop_false_positives(rows.where((F.col("type") != JSON_TYPE) | F.col("value_json").isNotNull()))


def is_real_value(value: Column, placeholders: Sequence[str] = PLACEHOLDER_VALUES,
                  min_length: int = MIN_VALUE_LENGTH) -> Column:
    """False for placeholders and for values too short to mean anything."""
    return ~F.lower(value).isin(*placeholders) & (F.length(value) >= min_length)


def drop_false_positives(candidates: DataFrame, placeholders: Sequence[str] = PLACEHOLDER_VALUES,
                         min_length: int = MIN_VALUE_LENGTH) -> DataFrame:
    """Keep real string values; structured values (null ``value``) always stay."""
    value = F.col("value")
    return candidates.where(value.isNull() | is_real_value(value, placeholders, min_length))


def config_patterns(text: Column, folded_text: Column, patterns: Sequence[SettingPattern] = SETTING_PATTERNS,
                    yaml: Column | None = None) -> Column:
    """The ordered candidate types of a text.

    Candidates are ordered pattern by pattern, so each type simply repeats as
    often as the pattern has kept matches: counting suffices, nothing is grouped.
    """
    repeated = []
    for pattern in patterns:
        guard = may_match(text, folded_text, pattern.needs, pattern.words)
        values = find_all(text, pattern.scan or pattern.regex, pattern.groups, pattern.not_after, guard)
        repeated.append(_repeat(pattern.name, F.size(F.filter(values, lambda v: is_real_value(v)))))
    objects = F.filter(find_all(text, JSON_BLOCK, guard=F.contains(text, F.lit("{"))), lambda b: F.try_parse_json(b).isNotNull())
    repeated.append(_repeat(JSON_TYPE, F.size(objects)))
    if yaml is not None:
        repeated.append(_repeat(YAML_TYPE, F.size(yaml)))
    return F.concat(*repeated)


def first_pass_summary(docs: DataFrame, patterns: Sequence[SettingPattern] = SETTING_PATTERNS,
                       keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: text length, candidate count, constant sentence, candidate types."""
    text = F.col("text")
    columns = dict.fromkeys([*keep, "text"])
    prepared = docs.select(*columns, folded(text).alias("_folded"), yaml_blocks(text).alias("_yaml"))
    types = config_patterns(text, F.col("_folded"), patterns, F.col("_yaml"))
    typed = prepared.select(*keep, F.length(text).cast("long").alias("length"), types.alias("config_patterns"))
    return typed.select(
        *keep, "length",
        F.size("config_patterns").cast("long").alias("potential_config_count"),
        F.lit(SUMMARY_SENTENCE).alias("document_summary"),
        "config_patterns",
    )


def _repeat(name: str, times: Column) -> Column:
    return F.array_repeat(F.lit(name), F.greatest(F.coalesce(times, F.lit(0)), F.lit(0)))


def _regex_part(i: int, pattern: SettingPattern, context: bool, width: int):
    return i, pattern.name, _finder(pattern, context, width)


def _finder(pattern: SettingPattern, context: bool, width: int):
    """The match array of a pattern, from the columns ``searched`` and ``folded``."""
    searched = F.col("searched")
    guard = may_match(searched, F.col("folded"), pattern.needs, pattern.words)
    if context:
        return find_all_in_context(searched, pattern.scan or pattern.regex, width, pattern.not_after, guard)
    return find_all(searched, pattern.scan or pattern.regex, 0, pattern.not_after, guard)


def _scanned(patterns: Sequence[SettingPattern]) -> list[int]:
    """The patterns whose matches come with digits before them."""
    return [i for i, p in enumerate(patterns) if p.scan]


def _located(docs: DataFrame, parts, context: bool, width: int, yaml_ord: int | None = None,
             scanned: Sequence[int] = ()) -> DataFrame:
    """Rows ``doc_id, pattern_ord, match_ord, type, hit, context``; ``hit`` starts with the match.

    ``stack`` turns the per-pattern match arrays of a document into rows
    without any lambda, ``posexplode`` the arrays into matches.  With
    ``yaml_ord``, the blocks in the column ``yaml`` follow, as ``block_json``.
    """
    text = F.col("text")
    prepared = docs.select(
        "doc_id", *([] if yaml_ord is None else ["yaml"]),
        pad_char(text).alias("pad"),
        (padded(text, width) if context else text).alias("searched"),
        folded(text).alias("folded"),
    )
    matches = _plain_matches(prepared, parts) if yaml_ord is None else _matches_and_blocks(prepared, parts, yaml_ord)
    around, extra = F.col("around"), [c for c in ("block_json",) if c in matches.columns]
    if scanned:  # what was found begins before the match by its leading digits
        found = F.substring(around, width + 1, TO_THE_END) if context else around
        extra_digits = F.length(found) - F.length(F.ltrim(found, F.lit(DIGITS)))
        around = F.when(F.col("pattern_ord").isin(*scanned), F.substring(around, extra_digits + 1, F.lit(TO_THE_END))).otherwise(around)
    if context:
        hit, shown = F.substring(around, width + 1, TO_THE_END), F.ltrim(around, F.col("pad"))
        shown = F.coalesce("block_context", shown) if extra else shown
    else:
        hit, shown = around, F.lit(None).cast("string")
    return matches.select("doc_id", "pattern_ord", "match_ord", "type", hit.alias("hit"), *extra, shown.alias("context"))


def _plain_matches(prepared: DataFrame, parts) -> DataFrame:
    """One row per match, ``around`` holding it and what surrounds it."""
    rows = [cell for i, name, found in parts for cell in (F.lit(i), F.lit(name), found)]
    stacked = prepared.select(
        "doc_id", "pad", F.stack(F.lit(len(parts)), *rows).alias("pattern_ord", "type", "hits"))
    return stacked.select("doc_id", "pad", "pattern_ord", "type", F.posexplode("hits").alias("match_ord", "around"))


def _matches_and_blocks(prepared: DataFrame, parts, yaml_ord: int) -> DataFrame:
    """The same with the YAML blocks as further rows, from one pass over the documents."""
    no_hits, no_blocks = F.array().cast("array<string>"), F.array().cast(BLOCKS_TYPE)
    rows = [cell for i, name, found in parts for cell in (F.lit(i), F.lit(name), found, no_blocks)]
    rows += [F.lit(yaml_ord), F.lit(YAML_TYPE), no_hits, F.col("yaml")]
    stacked = prepared.select(
        "doc_id", "pad", F.stack(F.lit(len(parts) + 1), *rows).alias("pattern_ord", "type", "hits", "blocks"))
    both = F.arrays_zip(F.coalesce("hits", no_hits).alias("hit"), F.col("blocks").alias("block"))
    exploded = stacked.select("doc_id", "pad", "pattern_ord", "type", F.posexplode(both).alias("match_ord", "both"))
    return exploded.select(
        "doc_id", "pad", "pattern_ord", "match_ord", "type",
        F.col("both.hit").alias("around"),
        F.col("both.block.json").alias("block_json"),
        F.col("both.block.context").alias("block_context"),
    )


def _key(pattern: SettingPattern) -> Column:
    if pattern.groups == 1:
        return F.lit(pattern.name)
    return F.regexp_extract("hit", to_java(pattern.regex), 1)


def _value(pattern: SettingPattern) -> Column:
    return F.regexp_extract("hit", to_java(pattern.regex), pattern.groups)


def _read_once(*columns: Column) -> Column:
    """The columns as a generator's output: a filter on them cannot move below and work them out again per mention."""
    return F.inline(F.array(F.struct(*columns)))


def _per_type(patterns: Sequence[SettingPattern], part) -> Column:
    """The key or value of a hit, read from the short hit itself."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, pattern in enumerate(patterns):
        chosen = chosen.when(F.col("pattern_ord") == i, part(pattern))
    return chosen


def _extract_with_python(docs: DataFrame, patterns: Sequence[SettingPattern], context: bool, width: int) -> DataFrame:
    found = [(i, p.name, f"(?<![{p.not_after}]){p.scan}" if p.scan else p.regex, p.groups, p.needs, bool(p.scan))
             for i, p in enumerate(patterns)]
    columns = ["doc_id", "pattern_ord", "match_ord", "type", "key", "value", "context"]

    def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(i, name, re.compile(regex), *rest) for i, name, regex, *rest in found]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for i, name, regex, groups, needs, scanned in compiled:
                    if text is None or (needs and needs not in text):
                        continue
                    for n, m in enumerate(regex.finditer(text)):
                        start = m.start(1) if scanned else m.start()
                        around = text[max(0, start - width):m.end() + width] if context else None
                        rows.append((doc_id, i, n, name, m.group(1) if groups > 1 else name, m.group(groups), around))
            yield pd.DataFrame(rows, columns=columns)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(matches, SETTINGS_SCHEMA.format(id=id_type))
