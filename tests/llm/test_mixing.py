"""Mixtures against their targets, and the permutations behind them."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from configsieve.llm import mixing, queries
from tests.llm.test_sharding import spark_hash

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    p = mixing.Permutation(n, 5)
    out = p.index(np.arange(n))
    assert sorted(out) == list(range(n))
    assert (p.slot(out) == np.arange(n)).all()


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([0, 10]) == [0.0, 15.0]
    assert mixing.targets([]) == []
    sizes = [7, 500, 90, 3, 44, 1200, 8]
    out = mixing.targets(sizes)
    assert sum(out) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s for t, s in zip(out, sizes))
    open_ = [k for k, (t, s) in enumerate(zip(out, sizes)) if t < 2 * s]
    assert len({round(out[k] / mixing.WEIGHTS[k % 3], 6) for k in open_}) <= 1


def test_shard_counts_sum_to_the_slots():
    counts = mixing.shard_counts([50, 0, 1000, 3], 16)
    assert counts.sum(0).tolist() == [50, 0, 1000, 3]
    assert counts.sum(1).max() - counts.sum(1).min() <= 1
    assert (counts >= 0).all()


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    assert Counter((r["_id"], r["_size"]) for r in rows) == Counter((d.doc_id, words(d.text)) for d in docs)
    taken, target, size = Counter(), {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["_size"]
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
    return taken


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.taken_words(mixing.mix(docs)).collect()
    for (_, target), taken in check(rows, docs.collect()).items():
        assert abs(taken - target) <= 1
    again = mixing.taken_words(mixing.mix(docs.repartition(3))).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_slots_are_filled_once(spark):
    mixture = mixing.mix(spark.read.parquet(f"{SF_DIR}/documents.parquet"), shards=4)
    slots = mixture.slots.collect()
    by_shard = Counter(r.shard for r in slots)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    for shard, n in by_shard.items():
        assert sorted(r.slot for r in slots if r.shard == shard) == list(range(n))
    assert max(Counter((r.source_number, r.block, r.draw) for r in slots).values()) == 1


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    taken = {r["_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(docs)).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found, texts = Counter(), {d.doc_id: d.text for d in docs.collect()}
    for r in mixed.collect():
        found[r.doc_id] += words(r.text)
        own = r.text.split()
        assert own[0] in texts[r.doc_id]
    assert {k: v for k, v in taken.items() if v} == dict(found)


def test_odd_documents(odd_documents, no_documents):
    rows = mixing.taken_words(mixing.mix(odd_documents)).collect()
    for (_, target), taken in check(rows, odd_documents.collect()).items():
        assert abs(taken - target) <= 1
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.taken_words(mixing.mix(no_documents)).count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0


def naive_targets(sizes):
    """The level at which min(weight * level, twice the size) adds up to the share of all, by bisection."""
    weight, due = [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes)
    lo, hi = 0.0, 2.0 * max(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(w * mid, 2 * s) for w, s in zip(weight, sizes)) < due else (lo, mid)
    return [min(w * hi, 2.0 * s) for w, s in zip(weight, sizes)]


def naive_mixture(docs):
    """By hand: source -> (size, target), and (doc_id, pass) -> the word numbers taken.

    The words of a source stand in a row; blocks are drawn pass by pass until the
    target is reached, and the last one is cut there.
    """
    by_source = defaultdict(list)
    for d in docs:
        by_source[d.source].append((d.doc_id, words(d.text)))
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, n in by_source[name]) for name in names]
    known, taken = {}, defaultdict(list)
    for number, (name, size, target) in enumerate(zip(names, sizes, naive_targets(sizes))):
        known[name] = (size, target)
        buckets = math.ceil(len(by_source[name]) / mixing.ORDER_ROWS)
        keys = {i: spark_hash(i, (mixing.SEED,)) for i, _ in by_source[name]}
        stream = [(i, k) for i, n in sorted(by_source[name], key=lambda x: (keys[x[0]] % buckets, keys[x[0]])) for k in range(n)]
        blocks = [stream[k : k + mixing.BLOCK] for k in range(0, size, mixing.BLOCK)]
        left, draw = round(target), 0
        while left:
            turn, index = divmod(draw, len(blocks))
            block = blocks[int(mixing.permutation(number, len(blocks), turn).index(np.array([index]))[0])][:left]
            for i, k in block:
                taken[i, turn].append(k)
            left, draw = left - len(block), draw + 1
    return known, taken


@pytest.mark.parametrize("order_rows", [mixing.ORDER_ROWS, 7])
def test_the_registered_query_by_hand(spark, monkeypatch, order_rows):
    monkeypatch.setattr(mixing, "ORDER_ROWS", order_rows)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len({d.doc_id for d in docs}) == len(docs)
    known, taken = naive_mixture(docs)
    sums = Counter()
    for (i, _), own in taken.items():
        sums[i] += len(own)
    rows = {r.doc_id: r for r in queries.op7_mixing(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r, (size, target) = rows[d.doc_id], known[d.source]
        assert (r["size"], r.source_size, r.taken) == (words(d.text), size, sums[d.doc_id])
        assert r.target == pytest.approx(target, rel=1e-9)


def test_mixed_texts_by_hand(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {d.doc_id: d.text for d in docs.collect()}
    _, taken = naive_mixture(docs.collect())
    want = Counter()
    for (i, _), own in taken.items():
        spans, runs = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])], []
        for k in sorted(own):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        whole = runs == [[0, len(spans) - 1]]
        want[i, texts[i] if whole else " ".join(texts[i][spans[a][0] : spans[b][1]] for a, b in runs)] += 1
    assert Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect()) == want
