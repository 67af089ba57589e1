"""Compiled schema checks against a recursive Python validator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from configsieve.operators import validate

TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool}

SCHEMA = {
    "type": "object",
    "required": ["name", "odd key", "it's"],
    "properties": {
        "name": {"type": "string"},
        "odd key": {"type": "integer"},
        "it's": {"type": "number"},
        "flag": {"type": "boolean"},
        "free": {},
        "strange": {"type": "money"},
        "broken": 5,
        "items": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {
            "id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
        "nested": {"type": "object", "properties": {"deep": {"type": "object", "required": ["x"], "properties": {
            "x": {"type": "array"}}}}},
    },
}


def model(value, schema, path="$"):
    if not isinstance(schema, dict):
        return [f"Invalid schema at {path}: schema must be an object"]
    kind = schema.get("type")
    if not kind:
        return []
    if kind not in TYPES:
        return [f"Unsupported type '{kind}' at {path}"]
    if not isinstance(value, TYPES[kind]):
        return [f"Expected {kind} at {path}, got {type(value).__name__}"]
    found = []
    if kind == "object":
        found += [f"Missing required property '{p}' at {path}" for p in schema.get("required", []) if p not in value]
        for name, part in schema.get("properties", {}).items():
            if name in value:
                found += model(value[name], part, f"{path}.{name}")
    if kind == "array" and "items" in schema:
        for i, item in enumerate(value):
            found += model(item, schema["items"], f"{path}[{i}]")
    return found


def random_config(rng, schema):
    wrong = [None, "s", 1, 2.5, 1.0, 10**20, True, [], {}, [1], {"a": 1}, "", 1e300]
    if not isinstance(schema, dict) or rng.random() < 0.2:
        return rng.choice(wrong)
    kind = schema.get("type")
    if kind == "object":
        config = {n: random_config(rng, p) for n, p in schema.get("properties", {}).items() if rng.random() < 0.7}
        return config | ({"extra": 1} if rng.random() < 0.3 else {})
    if kind == "array":
        return [random_config(rng, schema.get("items")) for _ in range(rng.randint(0, 3))]
    return {"string": "x", "integer": 3, "number": 2.5, "boolean": False}.get(kind, rng.choice(wrong))


def check(spark, configs, schema, **options):
    rows = [(i, json.dumps(c)) for i, c in enumerate(configs)]
    df = spark.createDataFrame(rows, "cfg_id int, text string").select("cfg_id", F.parse_json("text").alias("config"))
    return {r["cfg_id"]: r for r in validate.validate(df, schema, **options).select("cfg_id", "is_valid", "errors").collect()}


def test_errors_equal_model(spark):
    rng = random.Random(5)
    configs = [random_config(rng, SCHEMA) for _ in range(800)]
    found = check(spark, configs, SCHEMA)
    for i, config in enumerate(configs):
        assert found[i]["errors"] == sorted(model(config, SCHEMA)), config
        assert found[i]["is_valid"] == (not found[i]["errors"])


def test_bool_is_an_integer_unless_strict(spark):
    schema = {"type": "integer"}
    assert check(spark, [True], schema)[0]["is_valid"]
    assert check(spark, [True], schema, strict_bool=True)[0]["errors"] == ["Expected integer at $, got bool"]


def test_schema_without_type_accepts_everything(spark):
    assert check(spark, [1, None, {}], {"configSchema": SCHEMA})[0]["is_valid"]


def test_missing_configuration(spark):
    df = spark.createDataFrame([(1, None)], "cfg_id int, text string").select(F.parse_json("text").alias("config"))
    (row,) = validate.validate(df, SCHEMA).collect()
    assert row["errors"] == [validate.NO_OBJECT] and not row["is_valid"]


def test_empty_config():
    assert validate.empty_config(None) == {}
    assert validate.empty_config({"properties": {}}) is None
    schema = {"type": "object", "required": ["a", "b", "c", "d", "e"], "properties": {
        "a": {"type": "array"}, "b": {"type": "boolean"}, "c": {"type": "integer"}, "d": {}, "x": {"type": "string"},
        "e": {"type": "object", "required": ["s"], "properties": {"s": {"type": "string"}, "t": {"type": "string"}}}}}
    assert validate.empty_config(schema) == {"a": [], "b": False, "c": 0, "d": None, "e": {"s": ""}}


def test_gate(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}
    df = spark.createDataFrame([(1, '{"a": "x", "b": 1}'), (2, '{"a": 1}')], "cfg_id int, text string")
    gated = validate.gate(validate.validate(df.select("cfg_id", F.parse_json("text").alias("config")), schema), schema)
    assert {r[0]: (json.loads(r[1]), len(r[2])) for r in gated.select("cfg_id", F.to_json("config"), "errors").collect()} == {
        1: ({"a": "x", "b": 1}, 0), 2: ({"a": ""}, 1)}


@pytest.mark.parametrize("text,expected", [
    ('{}', []), ('{"host": null, "port": 80}', []), ('{"port": 0}', ["range:port"]), ('{"port": 65536}', ["range:port"]),
    ('{"port": "5432"}', []), ('{"port": "x", "host": 1}', ["type:host", "type:port"]), ('{"port": 80.0}', []),
    ('{"port": 80.5}', ["type:port"]), ('{"port": true}', []), ('{"port": false}', ["range:port"]), ('{"z": 1}', ["extra:z"]),
    ('{"port": -1}', ["range:port"]), ('[1]', ["type:$"]), ('nope', ["type:$"]), ('{"port": [1]}', ["type:port"]),
    ('{"port": 123456789012345678901234567890}', ["range:port"]),
])
def test_database_rows(spark, text, expected):
    df = spark.createDataFrame([(text,)], "row string")
    assert validate.check_database_rows(df).collect()[0]["violations"] == expected


@pytest.mark.parametrize("kind", [["string", "null"], {"a": 1}, 7, "flag", True])
def test_odd_types(spark, kind):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": kind}}}
    row = spark.range(1).select(F.parse_json(F.lit('{"a": 1}')).alias("config"))
    checked = validate.validate(row, schema).first()
    assert checked["errors"] == [f"Unsupported type '{kind}' at $.a"]
    assert validate.empty_config(schema) == {"a": None}
    assert validate.empty_config({"type": kind}) is None
    assert validate.empty_config(["type"]) is None
