"""Spelling variants against every possible edit of every word."""

import re
import string
import zlib
from collections import Counter

import pytest

from configsieve.llm import spelling
from configsieve.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["word", "form", "root", "n", "n_near", "form_n"]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(words):
    alphabet = {c for w in words for c in w}
    near = {w: [x for x in edits(w, alphabet) if x in words] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: x if x and words[x] >= 2 * words[w] else None for w, x in best.items()}
    out = set()
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        out.add((word, form[word], root, words[word], len(near[word]), words.get(form[word])))
    return out


def check(frame):
    got = [tuple(r) for r in spelling.variants(frame).collect()]
    want = brute(counted([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]))
    assert len(got) == len(set(got)) and set(got) == want
    return got


def test_query(spark):
    rows = QUERIES["op12_spelling_variants"](spark, SF_DIR)
    assert rows.columns == NAMES
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert set(map(tuple, rows.collect())) == brute(counted(docs))


def test_odd_documents(odd_documents):
    check(odd_documents)


def test_no_documents(no_documents):
    assert spelling.variants(no_documents).collect() == []


def repeated(words):
    """Ids and texts in which each word occurs so often, none spoilt."""
    rows = []
    for word, n in words.items():
        doc_id = next(i for i in range(10_000) if zlib.crc32(f"{i}:{word}".encode()) % 97)
        rows.append((doc_id, " ".join([word] * n)))
    return rows


def test_runs_ends_and_long_words(spark):
    """Deletions within runs of equal characters, at both ends, and words around the length beyond which prefixes are hashed."""
    long, longer = "ab" * 32, "xyz" * 700
    words = {
        "aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 30, "baaaa": 4, "aaaab": 5, "aabaa": 6, "abbba": 3, "abbbba": 8,
        "étété": 3, "ététés": 7, "tétés": 14, "×÷×÷×": 3,
        long: 5, long + "a": 11, long[:-1]: 3, long[:-1] + "c": 4, "c" + long: 25, long[1:] + "c": 3, long + "ab": 60, long[:63]: 3,
        longer: 3, longer[1:]: 7, longer[:900] + "q" + longer[900:]: 20, longer[:900] + "q" + longer[901:]: 3,
    }
    words.pop(long[:63], None)
    words[long[:63]] = 4
    got = check(spark.createDataFrame(repeated(words), "doc_id long, text string"))
    assert {r[0] for r in got} == set(words)


def test_a_chain_of_forms(spark):
    words = {"aaaaa" + "b" * k: 3 * 2**k for k in range(11)}
    got = check(spark.createDataFrame(repeated(words), "doc_id long, text string"))
    assert {r[2] for r in got} == {"aaaaa" + "b" * 10}


def test_ranges_across_batches(spark):
    """A range of many words, with batches of three rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark.createDataFrame(repeated({"word" + c: 3 + k for k, c in enumerate(string.ascii_lowercase)}), "doc_id long, text string"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("text", ["AbÀ×ß ÿz", "a\u0100b\u212a", "😀abc\x00def", "İstanbul"])
def test_runs(text):
    got = Counter()
    for word, n in spelling.spoilt_words(None, " ".join([text + "longer"] * 3)).items():
        got[word.decode("latin-1")] += n
    want = counted([(None, " ".join([text + "longer"] * 3))])
    assert dict(got) == want
