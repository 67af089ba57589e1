"""Chunking, section fields and relationships against plain Python models."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from catalog.oracles import recursive_chunks_sql
from configsieve.constants import CHUNK_SEPARATORS, DEFAULT_SECTION_TYPE, SECTION_KEYWORDS
from configsieve.functions.splitter import split_text
from configsieve.functions.text import fixed_chunks, heading, section_type
from configsieve.operators import sections

# A fixed value: the structured sample text that the checks are defined on.
SAMPLE = """
        Configuration Settings:
        host = localhost
        port = 8080

        Database Configuration:
        db_host = 127.0.0.1
        db_port = 5432

        API Settings:
        api_key = secret_key
        api_endpoint = /api/v1
        """


def split_model(text, size, overlap, separators):
    """The documented splitter behaviour, with regex splitting and slices."""
    chosen, rest = separators[-1], []
    for i, separator in enumerate(separators):
        if separator in text:
            chosen, rest = separator, separators[i + 1:]
            break
    cut = re.split(f"({re.escape(chosen)})", text)
    pieces = [p for p in [cut[0]] + [s + t for s, t in zip(cut[1::2], cut[2::2])] if p]
    result, run = [], []

    def emit(parts):
        if "".join(parts).strip():
            result.append("".join(parts).strip())

    def merge(parts):
        current = []
        for part in parts:
            if current and sum(map(len, current)) + len(part) > size:
                emit(current)
                while current and (sum(map(len, current)) > overlap or sum(map(len, current)) + len(part) > size):
                    current = current[1:]
            current = current + [part]
        emit(current)

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            if run:
                merge(run)
            run = []
            result.extend(split_model(piece, size, overlap, rest) if rest else [piece])
    if run:
        merge(run)
    return result


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    pieces = ["config", "Setting:", "option ", "parameter", " ", "\n", "\n\n", ". ", "!", "?", "; ", ", ", "word", "x" * 25,
              "\U0001f600", "\u00e9", "api", "db", "auth", "title:", "\u00a0", ":", "rest"]
    return ["", " ", SAMPLE] + ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("size,overlap", [(40, 10), (20, 0), (100, 99), (2000, 200)])
def test_recursive_chunks(docs, texts, size, overlap):
    rows = sections.chunk_documents(docs, "recursive", size, overlap).collect()
    expected = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(split_model(t, size, overlap, CHUNK_SEPARATORS))]
    assert sorted(map(tuple, rows)) == sorted(expected)


@pytest.mark.parametrize("size,overlap", [(40, 10), (7, 0), (5, 4), (2000, 200)])
def test_fixed_chunks(docs, texts, size, overlap):
    rows = sections.chunk_documents(docs, "fixed", size, overlap).collect()
    expected = [
        (i, n, t[start:start + size])
        for i, t in enumerate(texts) if t
        for n, start in enumerate(range(0, max(len(t) - overlap, 1), size - overlap))
    ]
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_bad_chunk_sizes():
    with pytest.raises(ValueError):
        fixed_chunks(F.col("text"), 10, 10)


HEADINGS = [
    ("Title:\nbody", "Title"), ("\n\n  Spaced out:  \nbody", "Spaced out"), ("a\nb\nc:\nd", "c"), ("a\nb\nc\nd:", None),
    (":", ""), ("::both::", "both"), ("::both", None), ("", None), ("x" * 98 + ":", "x" * 98), ("x" * 99 + ":", None),
    ("no colon", None), ("first:\nsecond:", "first"), ("mid: dle\nlast:", "last"), ("\u00a0odd:\u2003", "odd"), ("tab:\t", "tab"),
]


def test_headings(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(HEADINGS)], "id long, text string")
    found = {r[0]: r[1] for r in rows.select("id", heading(F.col("text"))).collect()}
    assert [found[k] for k in range(len(HEADINGS))] == [want for _, want in HEADINGS]


def first_listed_type(text):
    """The type of the first keyword list with a word in the text, as the constants have them."""
    hits = [name for name, keywords in SECTION_KEYWORDS for word in keywords if text.lower().find(word) >= 0]
    return (hits + [DEFAULT_SECTION_TYPE])[0]


def test_types(docs, texts):
    for doc_id, t in docs.select("doc_id", section_type(F.col("text"))).collect():
        assert t == first_listed_type(texts[doc_id])


def test_sample_text(spark):
    docs = spark.createDataFrame([(1, SAMPLE)], "doc_id long, text string")
    found = sections.identify_sections(docs)
    (row,) = found.collect()
    assert row["type"] == "configuration" and row["heading"] == "Configuration Settings" and row["id"] == 0
    assert row["length"] == len(row["content"]) == len(SAMPLE.strip())
    assert sections.config_sections(found).count() == 1
    assert sections.relate_sections(found).count() == 0


@pytest.mark.parametrize("block_bits", [0, 2, 9])
def test_relationships(docs, texts, block_bits):
    cut = sections.chunk_documents(docs, "fixed", 20, 5).cache()
    contents = {}
    for doc_id, i, content in cut.collect():
        contents.setdefault(doc_id, {})[i] = content.lower()
    terms = ["config", "setting", "parameter", "option"]
    expected = sorted(
        (d, i, j, "reference", 0.8)
        for d, parts in contents.items() for i in parts for j in parts
        if i != j and any(t in parts[i] and t in parts[j] for t in terms)
    )
    assert sorted(map(tuple, sections.relate_sections(cut, block_bits=block_bits).collect())) == expected and expected
    held = {(d, i, t) for d, parts in contents.items() for i, c in parts.items() for t in terms if t in c}
    assert {tuple(r) for r in sections.section_terms(cut).collect()} == held


def test_hot_document_spreads_over_keys(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("id"), F.lit("config").alias("content"))
    pairs = sections.relate_sections(rows)
    assert pairs.count() == 3000 * 2999


@pytest.mark.parametrize("size, overlap", [(12, 4), (7, 0), (30, 10), (9, 8)])
def test_recursive_splitter_equals_its_sql(size, overlap):
    """Random texts, cut by the library and by the recursive SQL of the queries."""
    rng = random.Random(size)
    bits = ["a", "bb", "ccc", "  ", "\n", "\n\n", ".", "!", "?", ";", ",", " ", "\u00a0", "\u00e9" * 9, "x" * 14]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for k in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", [*rows, (200, None)])
    found = con.execute(f"SELECT * FROM {recursive_chunks_sql('texts', size, overlap)} ORDER BY doc_id, id").fetchall()
    assert found == [(k, i, chunk) for k, text in rows for i, chunk in enumerate(split_text(text, size, overlap, CHUNK_SEPARATORS))]
