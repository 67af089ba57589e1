"""Merging the configuration fragments of a document under conflict rules.

Fragments are flattened to leaves, one row per ``(doc_id, ord, path)``, and
every path is decided by an aggregate that combines before the shuffle.  The
ordered pairwise merge this stands for is reproduced exactly, including paths
that hold an object in one fragment and something else in another:

* rule A: null loses; then values that are not defaults go before defaults, and
  within the same standing the first one wins - if that is a string, the longest
  string of the same standing (the first of the longest).
* rule B: null loses, then the first wins, except that a loopback string yields
  to the first string that is none.

An object takes part as one value: an empty one is a default, any other is not.
If an object wins its path, the objects of all fragments are merged below it;
if it loses, nothing below the path survives.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LOOPBACK_VALUES, MERGE_DEFAULTS

# Leaf kinds; the rest of JSON (bool, int, float, list) needs no special case.
NULL, STRING, OBJECT, INVALID = "null", "str", "dict", "invalid"
FILLED_OBJECT = "{...}"
# Answers without leaves, counted under paths that no pointer can have.
UNUSABLE, MISSING = "unusable", "missing"
SKIPPED_PATHS = {UNUSABLE: "?unusable", MISSING: "?missing"}

# What Spark's JSON parser takes; deeper answers are reported.
MAX_DEPTH = 1000
NOT_AN_OBJECT, TOO_DEEP = "not an object", f"nested deeper than {MAX_DEPTH} levels"

LEAF_COLUMNS = ["doc_id", "ord", "path", "vtype", "value"]


def pointer(path: str, key: str) -> str:
    """JSON pointer of a member."""
    return path + "/" + utf8(key).replace("~", "~0").replace("/", "~1")


def utf8(text: str) -> str:
    """The text with lone surrogates, which Arrow cannot carry, replaced."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def finite(number: str) -> float:
    """Parses a number; Python reads ``1e999`` and ``NaN``, JSON has no text for them."""
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(f"{number} is not a JSON number")
    return value


def depth_of(value) -> int:
    """Levels of objects and arrays in a value, counted without recursion."""
    deepest, open_values = 0, [(value, 1)]
    while open_values:
        value, level = open_values.pop()
        if isinstance(value, (dict, list)):
            deepest = max(deepest, level)
            open_values += [(member, level + 1) for member in (value.values() if isinstance(value, dict) else value)]
    return deepest


def leaves_of(value, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """``(path, vtype, value)`` of an object and everything in it; strings raw, the rest as JSON.

    A stack of its own, so that depth is not bounded by Python's.
    """
    open_values = [(path, value)]
    while open_values:
        path, value = open_values.pop()
        if isinstance(value, dict):
            yield path, OBJECT, FILLED_OBJECT if value else "{}"
            open_values += [(pointer(path, key), member) for key, member in reversed(value.items())]
        elif value is None:
            yield path, NULL, None
        elif isinstance(value, str):
            yield path, STRING, utf8(value)
        else:
            yield path, type(value).__name__, utf8(json.dumps(value, ensure_ascii=False))


def fragment_leaves(text: str | None) -> list[tuple[str, str, str | None]]:
    """Leaves of one answer.

    A skipped answer, one that is missing or not JSON, has a single leaf under a
    path that says so; one that is no object or nested too deeply has an
    ``invalid`` root that says why.
    """
    if text is None:
        return [(SKIPPED_PATHS[MISSING], MISSING, None)]
    try:
        value = json.loads(text, parse_float=finite, parse_constant=finite)
    except RecursionError:
        return [("", INVALID, TOO_DEEP)]
    except (TypeError, ValueError):
        return [(SKIPPED_PATHS[UNUSABLE], UNUSABLE, None)]
    if not isinstance(value, dict):
        return [("", INVALID, NOT_AN_OBJECT)]
    return [("", INVALID, TOO_DEEP)] if depth_of(value) > MAX_DEPTH else list(leaves_of(value))


def flatten_fragments(fragments: DataFrame, text_column: str = "response", skipped: bool = False, label: str = "Answer") -> DataFrame:
    """Leaves of JSON texts ``(doc_id, ord, <text_column>)``.

    Unparsable and missing texts yield none, or with ``skipped`` one each that
    :func:`merge_leaves` counts.  ``label`` and ``ord`` name a text in messages.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc_id, ord_, path, vtype, f"{label} {ord_}: {value}" if vtype == INVALID else value)
                for doc_id, ord_, text in zip(batch["doc_id"], batch["ord"], batch["text"])
                for path, vtype, value in fragment_leaves(text)
                if skipped or vtype not in SKIPPED_PATHS
            ]
            yield pd.DataFrame(rows, columns=LEAF_COLUMNS)

    id_type = fragments.schema["doc_id"].dataType.simpleString()
    return fragments.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col(text_column).alias("text")) \
        .mapInPandas(flatten, f"doc_id {id_type}, ord int, path string, vtype string, value string")


def merge_leaves(leaves: DataFrame, rule: str = "A") -> DataFrame:
    """The winner of every path: ``doc_id, path, vtype, value, lost``.

    ``lost`` marks paths where an object lost to another value; what lay below
    such an object is still in the result (see :func:`drop_shadowed`).
    """
    if rule not in ("A", "B"):
        raise ValueError(f"unknown conflict rule: {rule}")
    value, vtype = F.col("value"), F.col("vtype")
    is_null = vtype == NULL
    # A root that is no object spoils the document whatever else it holds.
    spoiled = vtype != INVALID
    if rule == "A":
        standing = F.coalesce(F.lower(value).isin(*MERGE_DEFAULTS), F.lit(False))
        first_key = F.struct(spoiled, is_null, standing, "ord")
        text_key = F.when(vtype == STRING, F.struct(standing, -F.length(value), F.col("ord")))
    else:
        loopback = F.lower(value).isin(*LOOPBACK_VALUES)
        first_key = F.struct(spoiled, is_null, "ord")
        text_key = F.when((vtype == STRING) & ~loopback, F.col("ord"))
    decided = leaves.groupBy("doc_id", "path").agg(
        F.min_by(F.struct("vtype", "value"), first_key).alias("first"),
        F.min_by("value", text_key).alias("text"),
        # A filled object sorts before an empty one.
        F.min(F.when(vtype == OBJECT, value)).alias("object"),
        # Counts of an earlier merge add up.
        F.sum(F.when(vtype.isin(*SKIPPED_PATHS), F.coalesce(value.try_cast("long"), F.lit(1)))).alias("skipped"),
        F.min(F.when(vtype == INVALID, F.struct("ord", "value"))).alias("invalid"),
    )
    first = F.col("first")
    yields = first["vtype"] == STRING
    if rule == "B":
        yields = yields & F.lower(first["value"]).isin(*LOOPBACK_VALUES)
    return decided.select(
        "doc_id", "path", first["vtype"].alias("vtype"),
        F.when(F.col("skipped") > 0, F.col("skipped").cast("string"))
        .when(F.col("invalid").isNotNull(), F.col("invalid.value"))
        .when(yields, F.coalesce("text", first["value"]))
        .when(first["vtype"] == OBJECT, F.col("object"))
        .otherwise(first["value"]).alias("value"),
        (F.col("object").isNotNull() & (first["vtype"] != OBJECT)).alias("lost"),
    )


def drop_shadowed(winners: DataFrame) -> DataFrame:
    """Without the paths below one where an object lost, and without ``lost``.

    Sorted by its parts, a path comes right before all that lies below it, so
    one look at each row in turn is enough, however many paths a document has.
    """
    columns = [c for c in winners.columns if c != "lost"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, covered = None, None
        for batch in batches:
            stays = []
            for doc_id, path, lost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "lost")), strict=True):
                if doc_id != document:
                    document, covered = doc_id, None
                below = covered is not None and path.startswith(covered)
                stays.append(not below)
                if lost and path and not below:
                    covered = path + "/"
            yield batch.filter(pa.array(stays, pa.bool_())).select(columns)

    dealt = winners.repartition("doc_id").sortWithinPartitions("doc_id", F.split("path", "/"))
    return dealt.mapInArrow(keep, winners.select(*columns).schema)


def merge_sources(sources: Sequence[DataFrame], rule: str = "B") -> DataFrame:
    """Leaves of several sources (such as text, then pictures), one winner per path: as :func:`merge_leaves`.

    The leaves of a source are merged among themselves first, then the results
    in the order of the sources.  That is not the order of all leaves: text
    ``localhost`` keeps its place before pictures ``5`` and ``db``, whose own
    winner ``5`` is no string.
    """
    merged = [drop_shadowed(merge_leaves(leaves, rule)).withColumn("ord", F.lit(n)) for n, leaves in enumerate(sources)]
    return merge_leaves(reduce(DataFrame.unionByName, merged), rule)


def assemble(winners: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, config_text, problem, used, unusable_answers, missing_answers``.

    ``config_text`` is null if a root was invalid (``problem`` says which and
    why) or no answer was ``used``.  What is gathered per document is its merged
    configuration, which is one output value anyway.
    """
    gathered = winners.groupBy("doc_id").agg(F.collect_list(F.struct("path", "vtype", "value")).alias("leaves"))
    return gathered.select("doc_id", _nested("leaves").alias("merged")).select("doc_id", "merged.*")


def merge_answers(fragments: DataFrame, rule: str = "A", text_column: str = "response") -> DataFrame:
    """All that is known of each document's answers, from one pass over them.

    ``doc_id, config`` (VARIANT), ``problems`` (messages about lost answers),
    ``used`` (whether any answer parsed), ``unusable_answers``, ``missing_answers``.
    """
    return answers_of(merge_leaves(flatten_fragments(fragments, text_column, skipped=True), rule))


def merge_answers_and_pictures(fragments: DataFrame, pictures: DataFrame, rule: str = "B", text_column: str = "response") -> DataFrame:
    """As :func:`merge_answers`, with what was read from a document's pictures merged under what was read from its text."""
    sources = [flatten_fragments(fragments, text_column, skipped=True), flatten_fragments(pictures, text_column, skipped=True, label="Picture")]
    return answers_of(merge_sources(sources, rule))


def answers_of(winners: DataFrame) -> DataFrame:
    merged = assemble(winners)
    config = F.try_parse_json("config_text")
    too_large = F.when(F.col("config_text").isNotNull() & F.col("config").isNull(), F.lit("The configuration is too large for a VARIANT"))
    kept = merged.select("doc_id", config.alias("config"), "config_text", "problem", "used", "unusable_answers", "missing_answers")
    problems = F.array_compact(F.array(F.col("problem"), too_large))
    return kept.select("doc_id", "config", problems.alias("problems"), "used", "unusable_answers", "missing_answers")


def merge_fragments(fragments: DataFrame, rule: str = "A", text_column: str = "response") -> DataFrame:
    """Merge JSON object texts ``(doc_id, ord, <text_column>)`` into one VARIANT ``config`` per document.

    Documents none of whose texts parse are absent; ``config`` is null where a
    text parsed to something other than an object, or is nested too deeply.
    """
    merged = assemble(merge_leaves(flatten_fragments(fragments, text_column), rule))
    return merged.select("doc_id", F.try_parse_json("config_text").alias("config"))


def nested_object(leaves) -> tuple[str | None, str | None, bool, int, int]:
    """Nested JSON text of ``(path, vtype, value)`` leaves, parents before children, and what else `assemble` returns."""
    objects, skipped, problem = {}, {UNUSABLE: 0, MISSING: 0}, None
    for leaf in sorted(leaves, key=lambda leaf: leaf["path"].count("/")):
        path, vtype, value = leaf["path"], leaf["vtype"], leaf["value"]
        if vtype in skipped:
            skipped[vtype] += int(value)
            continue
        if vtype == INVALID:
            problem = value
            continue
        above, _, key = path.rpartition("/")
        if path and above not in objects:
            continue
        member = {} if vtype == OBJECT else value if vtype in (STRING, NULL) else json.loads(value)
        if vtype == OBJECT:
            objects[path] = member
        if path:
            objects[above][key.replace("~1", "/").replace("~0", "~")] = member
    used = problem is not None or "" in objects
    text = json.dumps(objects[""], ensure_ascii=False, sort_keys=True) if used and problem is None else None
    return text, problem, used, skipped[UNUSABLE], skipped[MISSING]


MERGED_TYPE = "struct<config_text: string, problem: string, used: boolean, unusable_answers: long, missing_answers: long>"


def _nested(column: str) -> Column:
    @F.pandas_udf(MERGED_TYPE)
    def nested(leaves: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nested_object(x) for x in leaves], columns=["config_text", "problem", "used", "unusable_answers", "missing_answers"])

    return nested(F.col(column))
