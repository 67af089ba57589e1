"""Setting extraction against Python's ``re`` on random texts."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from configsieve.constants import (
    ASSIGNMENT_PATTERNS,
    JSON_BLOCK,
    PLACEHOLDER_VALUES,
    SETTING_PATTERNS,
    YAML_BLOCK,
    SettingPattern,
)
from configsieve.functions.regex import PAD_CHARS, find_all_in_context, pad_char, padded, strip, to_java
from configsieve.functions.yaml_blocks import block_start, linear_scan
from configsieve.operators import settings

PIECES = [
    "host", "HOST_name", "hostname", " = ", "=", '"x y"', "'abc'", "port", "8080", "path", "dir", "\u00a0", "\u2003",
    "\n", " ", "\U0001f600", "\u00e9", "\x00", "\x01", "\x1c", "user", "pwd", "password", "true", "{", "}", '{"a": 1}',
    "a:\n  b: 1\n  c: d\n", "http://x.y/z", "conn_str", "connection string", "timeout", "9ab", "a9_", "ab", ",",
    "x" * 30, "ho\u017ft=abc ", "D\u0130R = xyz ", "d\u0131r='abc' ", "pa\u017f\u017fword='abc' ", "\u0131", "\u017f", "config", "var", "options",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [""] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).cache()


def around(text, match, width=50):
    return text[max(0, match.start() - width):match.end() + width]


def expected_settings(texts, patterns=SETTING_PATTERNS, width=50):
    rows = []
    for doc_id, text in enumerate(texts):
        for i, pattern in enumerate(patterns):
            for n, m in enumerate(re.finditer(pattern.regex, text)):
                key = m.group(1) if pattern.groups == 2 else pattern.name
                rows.append((doc_id, i, n, pattern.name, key, m.group(pattern.groups), around(text, m, width)))
    return sorted(rows)


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_settings_equal_python(docs, texts, engine):
    found = settings.extract_settings(docs, engine=engine).collect()
    assert sorted(map(tuple, found)) == expected_settings(texts)


def test_settings_without_context(docs, texts):
    found = settings.extract_settings(docs, context=False).drop("context").collect()
    assert sorted(map(tuple, found)) == [row[:6] for row in expected_settings(texts)]


def test_other_width_and_pattern(docs, texts):
    pattern = (SettingPattern("pair", r"([a-z]+)\s*=\s*(\S+)", 2),)
    found = settings.extract_settings(docs, pattern, width=7).collect()
    assert sorted(map(tuple, found)) == expected_settings(texts, pattern, 7)


@pytest.mark.parametrize("regex", [r"(a)*", r"^(a)=(b)", r"(a)(?=b)", r"\b(a)=", r"a=b", r"(a)(b)(c)", r"(a)\1", r"(?P<x>a)=", r"(a)$"])
def test_unsuitable_patterns_are_rejected(docs, regex):
    with pytest.raises(ValueError):
        settings.extract_settings(docs, (SettingPattern("p", regex, 1),))


def test_suitable_patterns():
    for regex in (r"([^$^]+)=(\S)", r"(\$\w+)=(\d)", r"([]\]$]+)-(x)"):
        settings.check_pattern(regex)


def test_fixed_patterns_are_suitable():
    for pattern in SETTING_PATTERNS:
        settings.check_pattern(pattern.regex)


def expected_json(texts):
    rows = []
    for doc_id, text in enumerate(texts):
        for n, m in enumerate(re.finditer(JSON_BLOCK, text)):
            try:
                rows.append((doc_id, n, json.dumps(json.loads(m.group())), around(text, m)))
            except ValueError:
                continue
    return sorted(rows)


def test_json_blocks(docs, texts):
    found = settings.extract_json(docs).select("doc_id", "match_ord", F.to_json("value_json"), "context").collect()
    found = [(d, n, json.dumps(json.loads(v)), c) for d, n, v, c in found]
    assert sorted(found) == expected_json(texts)


def test_yaml_blocks(docs, texts):
    yaml = pytest.importorskip("yaml")
    expected = []
    for doc_id, text in enumerate(texts):
        n = 0
        for m in re.finditer(YAML_BLOCK, text):
            try:
                value = yaml.safe_load(m.group())
            except yaml.YAMLError:
                continue
            if isinstance(value, dict):
                expected.append((doc_id, n, json.dumps(value, sort_keys=True), around(text, m)))
                n += 1
    found = settings.extract_yaml(docs).select("doc_id", "match_ord", F.to_json("value_json"), "context").collect()
    found = [(d, n, json.dumps(json.loads(v), sort_keys=True), c) for d, n, v, c in found]
    assert sorted(found) == sorted(expected) and expected


def test_yaml_without_json_form(spark):
    pytest.importorskip("yaml")
    block = "a: \n  b: &x {c: *x}\n"
    odd = "a:\n  1: .nan\n  2024-01-02: 2024-01-01\n"
    docs = spark.createDataFrame([(1, block), (2, odd)], "doc_id long, text string")
    rows = dict(settings.extract_yaml(docs).select("doc_id", F.to_json("value_json")).collect())
    assert rows == {1: None, 2: '{"a":{"1":"nan","2024-01-02":"2024-01-01"}}'}
    assert settings.extract_candidates(docs).where("type = 'yaml_structure'").count() == 2


def test_candidates_are_the_union_without_false_positives(docs, texts):
    def real(value):
        return value.lower() not in PLACEHOLDER_VALUES and len(value) >= 3

    expected = [(d, i, n, t) for d, i, n, t, _, v, _ in expected_settings(texts) if real(v)]
    expected += [(d, 8, n, "json_structure") for d, n, _, _ in expected_json(texts)]
    found = settings.extract_candidates(docs).where("type <> 'yaml_structure'") \
        .select("doc_id", "pattern_ord", "match_ord", "type").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_summary_lists_the_candidate_types(docs):
    grouped = settings.extract_candidates(docs, context=False).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pattern_ord", "match_ord", "type"))), lambda r: r["type"]).alias("types"))
    summary = settings.first_pass_summary(docs).join(grouped, "doc_id", "left").collect()
    assert len(summary) == docs.count()
    for row in summary:
        assert row["config_patterns"] == (row["types"] or [])
        assert row["potential_config_count"] == len(row["types"] or [])


def test_no_shuffle(docs):
    for frame in (settings.extract_settings(docs), settings.extract_candidates(docs), settings.first_pass_summary(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("InMemoryTableScan")[0]


def test_settings_of_a_stream(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = settings.extract_settings(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("found").count() == settings.extract_settings(docs).count()


def test_java_patterns_search_like_python(docs, texts):
    columns = [F.rlike("text", F.lit(to_java(p))).alias(f"p{i}") for i, p in enumerate(ASSIGNMENT_PATTERNS)]
    for row in docs.select("doc_id", *columns).collect():
        for i, pattern in enumerate(ASSIGNMENT_PATTERNS):
            assert row[f"p{i}"] == bool(re.search(pattern, texts[row["doc_id"]]))


def test_strip(docs, texts):
    for doc_id, stripped in docs.select("doc_id", strip(F.col("text"))).collect():
        assert stripped == texts[doc_id].strip()


def test_texts_with_every_pad_character(spark):
    text = "".join(PAD_CHARS) + " host = abc, " + '{"a": 1}'
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert sorted(map(tuple, settings.extract_settings(docs).collect())) == expected_settings([text])
    assert settings.extract_json(docs).count() == 1
    assert {r.type for r in settings.extract_candidates(docs).collect()} == {"host", "key_value", "json_structure"}


def test_long_runs_of_letters_and_digits_take_linear_time(spark):
    text = "a1" * 500_000 + " 12ab34 = xyz " + "7b" * 100_000 + "=abc"
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    start = time.perf_counter()
    for engine in ("native", "arrow"):
        found = settings.extract_settings(docs, SETTING_PATTERNS[-1:], engine=engine).collect()
        assert [(r.key[:6], r.value) for r in found] == [("ab34", "xyz"), ("b7b7b7", "abc")]
        at = text.index("ab34")
        assert found[0].context == text[at - 50:at + len("ab34 = xyz") + 50]
    assert time.perf_counter() - start < 20


def test_python_engine_without_context(docs, texts):
    found = settings.extract_settings(docs, context=False, engine="arrow").collect()
    assert sorted(tuple(r)[:6] for r in found) == [row[:6] for row in expected_settings(texts)]
    assert all(r.context is None for r in found)


def test_yaml_blocks_of_random_texts(spark):
    """What the JVM finds in one pass is what `re` finds, at both ends of the text and around odd white space too."""
    pytest.importorskip("yaml")
    rng = random.Random(11)
    bits = ["a:", "b_1:", "\n", "\n", "\n\n", " ", "  ", "\t", "\u00a0", "\u2028", "\x1c", "  k: v\n", " x: 1", "é", "# c", "word\n", "k:\n  y: 2\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)]
    expected = [(d, m.start(), m.end()) for d, t in enumerate(texts) for m in re.finditer(YAML_BLOCK, t)]
    width = 50
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = frame.select("doc_id", pad_char(F.col("text")).alias("pad"), F.explode(
        find_all_in_context(padded(F.col("text"), width), linear_scan(width), width)).alias("piece")).collect()
    cut = [(r.doc_id, re.match(YAML_BLOCK, r.piece[block_start(r.piece, width, r.pad):]).group(), r.piece[block_start(r.piece, width, r.pad) - width:].lstrip(r.pad))
           for r in found]
    wanted = [(d, texts[d][a:b], texts[d][max(0, a - width):b + width]) for d, a, b in expected]
    assert len(expected) > 1000 and sorted(cut) == sorted(wanted)


@pytest.mark.parametrize("text", ["\n" * 1_000_000, "a:\n" + "\n" * 1_000_000, "a:\n" + " \n" * 500_000, ("a:" + " " * 50 + "\n") * 20_000,
                                  "a:\n" + "  k: v\n" * 150_000, "x " * 500_000 + "a:\n"])
def test_yaml_search_is_linear(spark, text):
    width = 50
    frame = spark.createDataFrame([(text,)], "text string").cache()
    frame.count()
    start = time.monotonic()
    frame.select(F.size(find_all_in_context(padded(F.col("text"), width), linear_scan(width), width))).collect()
    assert time.monotonic() - start < 2
