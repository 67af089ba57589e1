"""JSON-schema checks, compiled from the schema into expressions over a VARIANT."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DATABASE_RULE,
    INVALID_SCHEMA,
    MISSING_PROPERTY,
    NOT_A_SCHEMA,
    PORT_RANGE,
    SERVER_RULE,
    UNSUPPORTED_TYPE,
    WRONG_TYPE,
    WRONG_TYPE_FOUND,
)

# Python type names a value may have to satisfy a schema type.  A Python bool
# is an int, so it also passes as integer and number unless ``strict_bool``.
ACCEPTED = {
    "object": ("dict",),
    "array": ("list",),
    "string": ("str",),
    "number": ("int", "float", "bool"),
    "integer": ("int", "bool"),
    "boolean": ("bool",),
}

NO_OBJECT = "No configuration object at $"

# How the schema of a VARIANT names a JSON value, and what Python would make of
# it.  A decimal without fraction digits is an integer only if it is too wide
# for BIGINT; everything not listed is a float.
KIND = r"^(OBJECT|ARRAY|STRING|BIGINT|BOOLEAN|VOID|DECIMAL(?=\((?:19|[23]\d),0\)))?"
PYTHON_TYPES = {
    "OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "DECIMAL": "int",
    "BOOLEAN": "bool", "VOID": "NoneType", "": "float",
}


def validation_errors(config: Column, schema, *, strict_bool: bool = False) -> Column:
    """Sorted array of the messages a configuration draws from ``schema``.

    The driver walks the schema, never the data: each schema node becomes an
    expression over the part of the VARIANT it describes.  A missing (SQL NULL)
    configuration draws a message of its own.
    """
    errors = _node_errors(config, schema, F.lit("$"), strict_bool)
    return F.when(config.isNull(), F.array(F.lit(NO_OBJECT))).otherwise(F.array_sort(errors))


def validate(configs: DataFrame, schema, *, strict_bool: bool = False) -> DataFrame:
    """Adds ``is_valid`` and ``errors`` for the VARIANT column ``config``."""
    checked = configs.withColumn("errors", validation_errors(F.col("config"), schema, strict_bool=strict_bool))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def gate(validated: DataFrame, schema) -> DataFrame:
    """Replaces invalid configurations by the schema's empty one; ``errors`` stay."""
    valid = F.when(F.col("is_valid"), F.col("config"))
    return validated.withColumn("config", valid.otherwise(empty_variant(schema)))


def empty_config(schema: Mapping | None):
    """The least value of a schema: objects hold their required properties only.

    Null where the schema is no object or its type is none of JSON schema's names.
    """
    if not schema:
        return {}
    kind = schema.get("type") if isinstance(schema, Mapping) else None
    if kind == "object":
        required = schema.get("required", [])
        return {p: _empty_part(part) for p, part in schema.get("properties", {}).items() if p in required}
    return {"array": [], "string": "", "boolean": False, "number": 0, "integer": 0}.get(kind if isinstance(kind, str) else None)


def empty_variant(schema: Mapping | None) -> Column:
    """The empty configuration as a VARIANT; SQL NULL if the schema has no root type."""
    empty = empty_config(schema)
    return F.lit(None).cast("variant") if empty is None else F.parse_json(F.lit(json.dumps(empty)))


def check_typed_rows(rows: DataFrame, rule: Mapping[str, str],
                     ranges: Mapping[str, tuple[int, int]] | None = None, column: str = "row") -> DataFrame:
    """Adds ``violations``: what a flat JSON object text breaks of ``{field: string | integer}``.

    Every field is optional and may be null; other keys are forbidden.  An
    integer may be written as a number without fraction, a boolean or a
    numeric string.  The only entry of a text that is no object is ``type:$``.
    """
    columns = rows.columns
    parsed = rows.withColumn("_parsed", F.try_parse_json(column))
    members = parsed.select(
        *columns,
        F.coalesce(_python_type(F.col("_parsed")) == "dict", F.lit(False)).alias("_is_object"),
        F.json_object_keys(column).alias("_keys"),
        *[_python_type(F.variant_get("_parsed", _member_path(f), "variant")).alias(f"_kind_{f}") for f in rule],
        *[F.variant_get("_parsed", _member_path(f), "string").alias(f"_text_{f}") for f in rule],
    )
    extra = F.transform(F.array_except("_keys", F.array(*map(F.lit, rule))), lambda key: F.concat(F.lit("extra:"), key))
    checks = [_field_check(field, kind, (ranges or {}).get(field)) for field, kind in rule.items()]
    found = F.array_sort(F.concat(extra, F.array_compact(F.array(*checks))))
    return members.select(
        *columns, F.when(F.col("_is_object"), found).otherwise(F.array(F.lit("type:$"))).alias("violations"))


def check_database_rows(rows: DataFrame, column: str = "row") -> DataFrame:
    """The database row rule, port range included."""
    return check_typed_rows(rows, DATABASE_RULE, {"port": PORT_RANGE}, column)


def check_server_rows(rows: DataFrame, column: str = "row") -> DataFrame:
    """The server row rule."""
    return check_typed_rows(rows, SERVER_RULE, None, column)


def _field_check(field: str, kind: str, bounds: tuple[int, int] | None) -> Column:
    """The violation of one field of a typed row, or null."""
    found, text = F.col(f"_kind_{field}"), F.col(f"_text_{field}")
    wrong_type = F.lit(f"type:{field}")
    absent = found.isNull() | (found == "NoneType")
    if kind == "string":
        return F.when(~absent & (found != "str"), wrong_type)
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)(\.0*)?\s*$", 1)
    whole = (found == "bool") | (found.isin("int", "float", "str") & (digits != ""))
    check = F.when(absent, None).when(~whole, wrong_type)
    if bounds:
        number = F.when(found == "bool", (text == "true").cast("int")).otherwise(digits.try_cast("decimal(38,0)"))
        # A number too long to cast is outside every range.
        check = check.when(~F.coalesce(number.between(*bounds), F.lit(False)), F.lit(f"range:{field}"))
    return check


def _empty_part(schema: Mapping):
    return empty_config(schema) if schema else None


def _node_errors(value: Column, schema, path: Column, strict_bool: bool) -> Column:
    """Errors of ``value`` (not SQL NULL) against one schema node."""
    if not isinstance(schema, Mapping):
        return _one_error(F.lit(INVALID_SCHEMA), path, F.lit(NOT_A_SCHEMA))
    kind = schema.get("type")
    if not kind:
        return _no_errors()
    if not isinstance(kind, str) or kind not in ACCEPTED:  # a list of types has no hash
        return _one_error(F.lit(UNSUPPORTED_TYPE.format(kind)), path)
    accepted = [name for name in ACCEPTED[kind] if name != "bool" or kind == "boolean" or not strict_bool]
    found = _python_type(value)
    mismatch = _one_error(F.lit(WRONG_TYPE.format(kind)), path, F.lit(WRONG_TYPE_FOUND), found)
    if kind == "object":
        inner = _object_errors(value, schema, path, strict_bool)
    elif kind == "array" and "items" in schema:
        inner = _array_errors(value, schema["items"], path, strict_bool)
    else:
        inner = _no_errors()
    return F.when(found.isin(*accepted), inner).otherwise(mismatch)


def _object_errors(value: Column, schema: Mapping, path: Column, strict_bool: bool) -> Column:
    def member(name):
        return F.variant_get(value, _member_path(name), "variant")

    parts = [
        F.when(member(name).isNull(), _one_error(F.lit(MISSING_PROPERTY.format(name)), path))
        .otherwise(_no_errors())
        for name in schema.get("required", [])
    ]
    for name, part in schema.get("properties", {}).items():
        errors = _node_errors(member(name), part, F.concat(path, F.lit(f".{name}")), strict_bool)
        parts.append(F.when(member(name).isNotNull(), errors).otherwise(_no_errors()))
    return F.concat(*parts) if parts else _no_errors()


def _array_errors(value: Column, items, path: Column, strict_bool: bool) -> Column:
    def of_item(item, i):
        item_path = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return _node_errors(item, items, item_path, strict_bool)

    return F.flatten(F.transform(value.cast("array<variant>"), of_item))


def _python_type(value: Column) -> Column:
    """Name of the Python type the JSON value would have; null for an absent value."""
    names = F.create_map(*[F.lit(part) for pair in PYTHON_TYPES.items() for part in pair])
    return names[F.regexp_extract(F.schema_of_variant(value), KIND, 1)]


def _member_path(name: str) -> str:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"property name holds both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _one_error(*parts: Column) -> Column:
    return F.array(F.concat(*parts))
