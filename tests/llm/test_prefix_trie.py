"""The trie against one built node by node."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from configsieve.llm import prefix_trie as trie
from configsieve.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text), turns of a conversation with different numbers."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    nodes = defaultdict(lambda: {"members": [], "ends": [], "children": set()})
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        whole = tuple(own.get(conv - conv % 20, [])[:h] + own[conv][h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]]["members"].append(conv)
            if d < len(whole):
                nodes[whole[:d]]["children"].add(whole[: d + 1])
        nodes[whole]["ends"].append(conv)
    out = set()
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = [sums[c] for c in node["children"]]
        sums[key] = (sum(b[0] for b in below) or 1, (len(node["members"]) - 1) * words + sum(b[1] for b in below))
    for key, node in nodes.items():
        ends = ",".join(map(str, sorted(node["ends"])))
        out.add((min(node["members"]), len(key), min(nodes[key[:-1]]["members"]) if key else None, len(node["members"]),
                 len(node["children"]), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(nodes)


def check(frame):
    got = [tuple(r) for r in trie.prefix_trie(frame).collect()]
    want, n = brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == n
    assert set(got) == want


def test_query(spark):
    rows = QUERIES["op13_prefix_trie"](spark, SF_DIR)
    assert rows.columns == NAMES
    assert {t for _, t in rows.dtypes} == {"bigint", "string"}
    want, n = brute([tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()])
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == n and set(got) == want


def test_shared_beginnings_and_odd_rows(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(0, 240):
        if conv in (40, 100):
            continue
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn * 3, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b c", "", None, "d  e\tf"])))
    rows += [(7, None, "user", "first"), (None, 1, "user", "lost"), (-20, 1, "user", "a"), (-21, 5, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for k, name in enumerate(("a", "b", "depth", "conv", "n", "words", "band", "place")):
        frame = frame.selectExpr("*", f"{k} AS `{name}`")
    check(frame)


def test_long_conversations_cross_bands(spark):
    shared = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(300)]
    rows = []
    for conv, n, twist in ((0, 300, None), (1, 300, None), (2, 300, 299), (3, 200, None), (4, 130, 64), (5, 64, None), (6, 65, None), (25, 300, 128)):
        rows += [(conv, k, shared[k][0], shared[k][1] + ("!" if twist is not None and k >= twist else "")) for k in range(n)]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_intervals_across_ranges(spark, monkeypatch):
    """A hot beginning that covers many sorted ranges, and ids in several pieces."""
    monkeypatch.setattr(trie, "SORTED_ROWS", 40)
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    rows = [(c, t, "user", "hot" if t < 2 or c % 3 else f"own {c % 11}") for c in range(900) for t in range(3)]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_repeated_rows_are_turns(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "a")]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(r.depth for r in got.collect()) == [0, 1, 2, 3, 4]


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(frame).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_extents(seed):
    rng = np.random.default_rng(seed)
    lcp = rng.integers(0, 4, rng.integers(1, 40)).astype(np.int64)
    lcp[0] = 0
    row, depth = np.repeat(np.arange(len(lcp)), 3), np.tile([1, 2, 3], len(lcp))
    left, right = trie.extents(lcp, row, depth)
    for i, d, lo, hi in zip(row, depth, left, right):
        a, b = i, i
        while a > 0 and lcp[a] >= d:
            a -= 1
        while b + 1 < len(lcp) and lcp[b + 1] >= d:
            b += 1
        assert (lo, hi) == (a, b)
    values = rng.integers(-9, 9, len(lcp))
    assert list(trie.least_between(trie.sparse_table(values), left, right)) == [min(values[a : b + 1]) for a, b in zip(left, right)]
