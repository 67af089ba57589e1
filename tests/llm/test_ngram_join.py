"""The join against a brute-force one, with buckets and blocks of all kinds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from configsieve.llm import ngram_join
from configsieve.llm.components import components, joined_roots

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    """(id, links, smallest id of the class) of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    near = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    out, seen = [], {}
    for k in range(len(rows)):
        todo, group = [k], {k}
        while k not in seen and todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        if k not in seen:
            least = min(rows[g][0] for g in group)
            seen.update(dict.fromkeys(group, least))
        out.append((rows[k][0], len(near[k]), seen[k]))
    return Counter(out)


def copies(seed, n, length, changes):
    """n texts that differ from one another in a few words."""
    rng = random.Random(seed)
    base = [f"b{seed}x{k}" for k in range(length)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(length)] = f"c{k}x{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = copies(1, 60, 120, 3) + copies(2, 25, 300, 8) + copies(3, 12, 30, 1)
    texts += [passage + " " + " ".join(f"u{k}x{j}" for j in range(90)) for k in range(70)]
    texts += ["a b", "a b", "a b c", "", None, "  ", "one", "one"] + texts[:3]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(frame):
    return Counter((r.doc_id, r.n_links, r.class_id) for r in frame.collect())


def test_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found(ngram_join.classes(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("leaf", "block", "depth"), [(256, 1024, 4), (6, 16, 2), (3, 4, 3)])
def test_groups_of_copies(spark, rows, monkeypatch, leaf, block, depth):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "DEPTH", depth)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.classes(docs)) == brute(rows)


def test_pivots_connect_across_batches(spark, rows, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        monkeypatch.setattr(ngram_join, "LEAF", 2)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(ngram_join.classes(docs)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_are_repeated_until_the_audit_is_passed(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "RUNS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used = []
    once = ngram_join.run_links
    monkeypatch.setattr(ngram_join, "run_links", lambda nodes, runs: used.append(runs) or once(nodes, runs))
    assert found(ngram_join.classes(docs)) == brute(rows)
    assert len(used) > 1


def test_one_of_each(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {least for _, _, least in brute(rows)}


def test_intersections():
    rng = np.random.default_rng(1)
    for m in (2, 3, 5, 40):
        sets = [np.unique(rng.integers(0, 120, rng.integers(1, 90))).astype(np.uint64) for _ in range(m)]
        common = ngram_join.intersections(sets)
        for a in range(m):
            for b in range(m):
                if a != b:
                    assert common[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_odd_documents(odd_documents, no_documents):
    texts = [(d.doc_id, d.text) for d in odd_documents.collect()]
    named = [x for x in texts if x[0] is not None]
    result = ngram_join.classes(odd_documents).collect()
    assert Counter(r.doc_id for r in result) == Counter(i for i, _ in texts)
    want = brute([*named, (10**6, dict(named)[6])])  # the row without id is a copy of document 6
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in result if r.doc_id is not None) == Counter(
        {k: v for k, v in want.items() if k[0] != 10**6})
    kept = ngram_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert ngram_join.classes(no_documents).count() == ngram_join.one_of_each(no_documents).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: k for k, x in enumerate(nodes)}
    pairs = [(place[a], place[b]) for a, b in edges if a != b]
    roots = joined_roots(len(nodes), [a for a, _ in pairs], [b for _, b in pairs])
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {x: nodes[roots[k]] for x, k in place.items()}


def test_documents_without_an_id_are_of_classes(spark):
    """Exact and near copies without ids, beside documents with one and among themselves; texts that differ in blanks only."""
    body = [f"v{k}" for k in range(80)]
    other, third = [f"o{k}" for k in range(80)], [f"p{k}" for k in range(80)]
    near = lambda words, tail: " ".join([*words[:-1], tail])
    rows = [(4, " ".join(body)), (None, " ".join(body)), (None, near(body, "x")), (2, near(body, "y"))]
    rows += [(None, " ".join(other)), (None, " ".join(other)), (None, near(other, "x")), (None, "  ".join(other))]
    rows += [(None, " ".join(third)), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _hash int")
    kept = sorted(((r.doc_id, tuple((r.text or "").split())) for r in ngram_join.one_of_each(docs).collect()), key=str)
    assert [i for i, _ in kept if i is not None] == [2]
    without = [t for i, t in kept if i is None]
    assert len(without) == 4 and without.count(()) == 2 and tuple(third) in without
    assert sum(t[:-1] == tuple(other)[:-1] for t in without) == 1
    links = Counter((r.doc_id, r.n_links, r.class_id) for r in ngram_join.classes(docs).collect())
    assert links == Counter([(4, 3, 2), (None, 3, 2), (None, 3, 2), (2, 3, 2), *[(None, 3, None)] * 4, *[(None, 0, None)] * 3])


def test_audit_draws_until_enough_nodes_have_partners(spark, monkeypatch):
    """A tenth of the nodes have a partner, and none of them is connected: one group of connected copies hides nothing."""
    monkeypatch.setattr(ngram_join, "AUDITED", 32)
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 1 << 32, (1200, ngram_join.TOKENS), dtype=np.uint64).astype(np.uint32)
    tokens[1080:1140] = tokens[1140:]
    tokens[:20] = tokens[0]
    nodes = spark.createDataFrame([(k, t.tobytes()) for k, t in enumerate(tokens)], "node long, tokens binary")
    connected = spark.createDataFrame([(k, 0) for k in range(20)], "node long, component long")
    drawn, once = [], ngram_join.audit
    monkeypatch.setattr(ngram_join, "audit", lambda n, c, size: drawn.append(size) or once(n, c, size))
    assert ngram_join.audited_recall(nodes, connected) < 0.5
    assert len(drawn) > 1
    both = connected.unionByName(spark.createDataFrame([(k, 1080 + k % 60) for k in range(1080, 1200)], "node long, component long"))
    assert ngram_join.audited_recall(nodes, both) == 1.0
