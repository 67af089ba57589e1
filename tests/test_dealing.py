"""Short rows of one split are spread before anything is made of them; what is read from a hit is read once."""

import pytest
import yaml
from pyspark.sql import functions as F

from catalog.tables import NARROW_TABLES, derived
from configsieve.constants import SETTING_PATTERNS
from configsieve.functions import yaml_blocks
from configsieve.operators import merge, settings
from configsieve.sources.tables import dealt


def customers(spark, tmp_path, count):
    folder = f"{tmp_path}/tables"
    rows = spark.range(count).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def rows_per_task(frame):
    counts = frame.groupBy(F.spark_partition_id().alias("task")).count().collect()
    return [r["count"] for r in counts]


def test_dealt_bounds_the_rows_of_a_task_and_keeps_all(spark):
    rows = spark.range(5000).coalesce(1).select((F.col("id") % 3).alias("key"), F.lit(None).cast("string").alias("none"))
    spread = dealt(rows, per_task=100)
    counts = rows_per_task(spread)
    assert len(counts) == 50 and max(counts) < 200
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, rows.collect()))
    assert dealt(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["corpus", "answers", "odd_answers", "configs", "fragments"])
def test_derived_rows_of_one_row_group_are_spread(spark, tmp_path, name):
    assert "customer" in NARROW_TABLES
    made = derived(spark, customers(spark, tmp_path, 40_000), name)
    counts = rows_per_task(made)
    assert len(counts) >= 3 and max(counts) < made.count() / 2


def test_leaves_are_made_in_many_tasks(spark, tmp_path):
    answers = derived(spark, customers(spark, tmp_path, 40_000), "answers").withColumnRenamed("chunk_id", "ord")
    counts = rows_per_task(merge.flatten_fragments(answers))
    assert len(counts) >= 3 and max(counts) < sum(counts) / 2


def test_threads_have_room_for_deep_configurations(spark):
    for side in ("driver", "executor"):
        assert "-Xss4m" in spark.sparkContext.getConf().get(f"spark.{side}.extraJavaOptions")
    deep = '{"a":' * merge.MAX_DEPTH + "1" + "}" * merge.MAX_DEPTH
    rows = spark.range(20_000).coalesce(1).select("id", F.when(F.col("id") % 500 == 499, deep).otherwise('{"k":"v"}').alias("text"))
    written = rows.select("text", F.to_json(F.parse_json("text")).alias("json"))
    assert written.where("text = json").count() == 20_000


def filters(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Filter")]


def test_a_filter_reads_no_hit_again(spark):
    docs = spark.createDataFrame([(1, 'port = 8080\nhost = "db"\nuser = "test"\n{"a": 1}\nx:\n  y: 1\n')], "doc_id long, text string")
    for found in (settings.drop_false_positives(settings.extract_settings(docs)), settings.extract_candidates(docs), settings.extract_json(docs)):
        assert found.count() > 0
        assert not any("regexp_extract(" in line or "parse_json" in line for line in filters(found))
    found = settings.drop_false_positives(settings.extract_settings(docs, SETTING_PATTERNS))
    assert found.columns == ["doc_id", "pattern_ord", "match_ord", "type", "key", "value", "context"]


def load(block, loader):
    try:
        return repr(yaml.load(block, loader))
    except (yaml.YAMLError, ValueError):
        return "error"


@pytest.mark.parametrize("block", [
    "server:\n  ip: 10.0.0.1\n  uptime: 99\n", "\na:\n  b: 2024-01-01\n  c: 012\n", "a:\n  b: 2024-99-99\n", "a:\n    b: 1\n  c: 2\n",
    "a: x\n  b: 1\n", "a:\n  y: yes\n  n: null\n  e: 1e3\n", "".join(" " * i + "k:\n" for i in range(65)),
])
def test_plain_blocks_are_read_alike_by_both_parsers(block):
    assert yaml_blocks.PLAIN_BLOCK.fullmatch(block)
    assert load(block, yaml.SafeLoader) == load(block, yaml_blocks.FAST_LOADER)


@pytest.mark.parametrize("block", ["a:\n  - 1\n", "a:\n  b: [1]\n", "a:\n\tb: 1\n", "a:\n  b: 'x'\n", "a:\n  b: c:d\n", "a:\n  b: \u00e9\n", "a:\n" + " " * 65 + "b: 1\n"])
def test_other_blocks_go_to_pythons_parser(block):
    assert not yaml_blocks.PLAIN_BLOCK.fullmatch(block)


def test_plain_blocks_take_the_fast_parser(monkeypatch):
    used = []
    monkeypatch.setattr(yaml_blocks.yaml, "load", lambda block, loader: used.append(loader) or {})
    yaml_blocks.parse_block("a:\n  b: 1\n")
    yaml_blocks.parse_block("a:\n  b: [1]\n")
    assert used == [yaml_blocks.FAST_LOADER, yaml.SafeLoader]
