"""Similarity join of documents on word n-grams: chosen paths, then an exact check.

Two documents are linked when the Jaccard similarity of their sets of five-word
windows is 0.8 or more.  Documents with equal sets are one node from the start.

Chosen paths: every node has a fixed number of sampled tokens (position and
minimum hash).  A run chooses positions at random; nodes that share the token at
a chosen position meet in a bucket.  Small buckets are compared by brute force on
all sampled tokens.  In a large one all nodes are compared with a few pivots,
and those close to one leave it: whatever they are similar to is connected to
the pivot as well (distances of sets obey the triangle inequality).  The others
are split again, by positions chosen for their path, down to DEPTH; what is
still large then is compared in pairs of blocks, so no task holds a whole bucket
and no pair is left out.  Runs are repeated
until an audit finds the target recall: sampled nodes are compared with all
nodes, and the similar ones must have been connected.

The connected candidates are checked exactly: within each connected set, in
blocks if it is large, the whole sets of windows are intersected.  Links are
counted per node there and never written out as pairs.

Edge cases: a text with fewer than five words is one window of all its words;
null texts and texts without words link with nothing; equal texts link; equal
rows count as documents of their own; a document without an id is compared like
the others, and its class id is null where no document of the class has one; an empty table gives an empty result; other columns are ignored by `joined` and
pass through `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from configsieve.llm.components import components, joined_roots
from configsieve.llm.storage import settled
from configsieve.llm.token_counts import Cache

WINDOW = 5
#: Similarity as a fraction of whole numbers, compared without rounding.
SIMILAR = (4, 5)
TOKENS = 64
#: Share of equal sampled tokens from which a pair is a candidate: four deviations below the similarity.
CANDIDATE = 0.6
#: Pivots of a large bucket; the share of equal tokens that connects to a pivot, and that from which a node
#: leaves: what is similar to it then shares at least LEAVE - 0.2 with the pivot, and some more than NEAR.
PIVOTS = 8
NEAR = 0.5
LEAVE = 0.75
#: Nodes of a bucket that are compared by brute force; and of a block.
LEAF = 256
BLOCK = 512
#: Windows of a block.
BLOCK_WINDOWS = 500_000
#: Hashes of words that a task keeps, twice over at most.
HASHES = 50_000
DEPTH = 4
RUNS = 12
#: Nodes that an audit draws at first, and at most where few of them have partners.
AUDITED = 256
MOST_AUDITED = 4096
PARTNERED = 32
RECALL = 0.99
SEED = 0x5EED

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MUL
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def windows(data: bytes, hashes: Callable[[bytes], int], width: int = WINDOW) -> np.ndarray:
    """The sorted set of hashed windows of a text; empty without words."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = mixed(total * _MUL + ids[k : k + n])
    return np.unique(total)


_RNG = np.random.default_rng(SEED)
_FACTORS = (_RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)


def sampled_tokens(own: np.ndarray) -> np.ndarray:
    """For each position, the smallest of the set's values under that position's hash."""
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(short), 4096):
            x = (short[k : k + 4096] ^ _SHIFTS[:, None]) * _FACTORS[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            low = np.minimum(low, x.min(1))
    return low


def node_of(own: np.ndarray) -> int:
    """One number for a set of windows, as a signed 64-bit value."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def document_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n (windows) and tokens of every document; node is null without words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Cache(word_hash, HASHES).__getitem__
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            for text in batch.column(1):
                own = windows((text.as_py() or "").encode("utf-8", "surrogatepass"), hashes)
                nodes.append(node_of(own) if len(own) else None)
                sizes.append(len(own))
                tokens.append(sampled_tokens(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())],
                names=["doc_id", "text_hash", "node", "n", "tokens"],
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(make, "doc_id long, text_hash long, node long, n long, tokens binary")


def tokens_of(column: pa.Array, kind: type) -> np.ndarray:
    """A column of token bytes as a matrix, one row per node."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), TOKENS)


def run_positions(run: int) -> np.ndarray:
    """The positions a run chooses at its root: each with the odds of 1 / (similarity * TOKENS), one at least."""
    draws = np.random.default_rng([SEED, run]).random(TOKENS)
    chosen = np.flatnonzero(draws < SIMILAR[1] / (SIMILAR[0] * TOKENS))
    return chosen if len(chosen) else np.array([int(draws.argmin())])


def child_paths(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths one level down; nodes on the same path choose the same positions."""
    with np.errstate(over="ignore"):
        draws = mixed(paths[:, None] + _MUL * np.arange(1, TOKENS + 1, dtype=np.uint64))
        chosen = draws < np.uint64(int(2**64 * SIMILAR[1] / (SIMILAR[0] * TOKENS)))
        chosen[np.arange(len(paths)), draws.argmin(1)] = True
        row, position = np.nonzero(chosen)
        step = mixed(draws[row, position] + tokens[row, position].astype(np.uint64))
        return row, mixed(paths[row] ^ step)


def first_paths(nodes: DataFrame, runs: range) -> DataFrame:
    """path and node for every position that a run chooses."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, tokens = batch.column(0).to_numpy(), tokens_of(batch.column(1), np.uint32).astype(np.uint64)
            for run in runs:
                for position in run_positions(run):
                    key = np.uint64((run * TOKENS + int(position) + 1) << 32)
                    path = mixed(tokens[:, position] + key).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(own)], names=["path", "node"])

    return nodes.select("node", "tokens").mapInArrow(make, "path long, node long")


def short_tokens(tokens: np.ndarray) -> list[bytes]:
    """Half of each token's bits: enough to compare with."""
    return [row.tobytes() for row in (tokens & np.uint32(0xFFFF)).astype(np.uint16)]


def shared_paths(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose path others share, with the path's `size`: (up to LEAF nodes, more)."""
    sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    shared = level.join(sizes.hint("merge"), "path")  # as many rows as there are shared paths: not to broadcast
    return shared.where(F.col("size") <= LEAF), shared.where(F.col("size") > LEAF)


def compared_with_pivots(rows: DataFrame) -> DataFrame:
    """The rows (path, node, tokens) with `to`, a node they are connected to through pivots, and `leaves`.

    A path's pivots are the nodes with the smallest hashes, one for each of PIVOTS hash functions.
    Rows without tokens only say what pivots are connected to.
    """
    pivots = rows.groupBy("path").agg(
        *(F.min_by(F.struct("node", "tokens"), F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS))
    )
    names = [f"p{k}" for k in range(PIVOTS)]
    apart = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in ("node", "tokens") for p in names]
    joined = rows.select("path", "node", "tokens").join(pivots.select("path", *apart).hint("merge"), "path")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, leave = int(np.ceil(NEAR * TOKENS)), int(np.ceil(LEAVE * TOKENS))
        for batch in batches:
            if not batch.num_rows:
                continue
            node, tokens = batch.column("node").to_numpy(), tokens_of(batch.column("tokens"), np.uint16)
            pivot = np.stack([batch.column(f"{p}_node").to_numpy() for p in names], 1)
            equal = np.stack([(tokens_of(batch.column(f"{p}_tokens"), np.uint16) == tokens).sum(1) for p in names], 1)
            linked = equal >= near
            # Connected within the batch: one link for each row says what all of them say.
            known, number = np.unique(np.concatenate([node, pivot.ravel()]), return_inverse=True)
            own, others = number[: len(node)], number[len(node) :].reshape(pivot.shape)
            row, at = np.nonzero(linked)
            roots = known[joined_roots(len(known), own[row], others[row, at])]
            columns = [*(batch.column(c) for c in ("path", "node", "tokens")), pa.array(roots[own]), pa.array((equal >= leave).any(1))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "node", "tokens", "to", "leaves"])
            # The pivots themselves may be in other batches: their links tie the batches together.
            met = np.unique(others[row, at])
            columns = [pa.array(np.zeros(len(met), np.int64)), pa.array(known[met]), pa.nulls(len(met), pa.binary()),
                       pa.array(roots[met]), pa.array(np.ones(len(met), bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "node", "tokens", "to", "leaves"])

    return joined.mapInArrow(make, "path long, node long, tokens binary, to long, leaves boolean")


def split_paths(rows: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, path = child_paths(batch.column(0).to_numpy().view(np.uint64), tokens_of(batch.column(2), np.uint16))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], names=["path", "node", "tokens"]
            )

    return rows.select("path", "node", "tokens").mapInArrow(make, "path long, node long, tokens binary")


def block_pairs(rows: DataFrame, n_blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks its own block is in: columns `own`, `one` and `two` (one <= two).

    Every two rows of a group meet in exactly one pair of blocks.
    """
    dealt = rows.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), "n_blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group ends, from rows sorted by the first `keys` columns (long)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        same = (key == key[:, -1:]).all(0)
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held and (last or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys))):
            new = any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys))
            head = [] if new and not last else [batch.slice(0, last)]
            # What was joined is let go before it is worked on.
            whole, held = joined_batch([*held, *head]), [batch.slice(last)] if last else [batch]
            yield whole
        elif last:
            yield batch.slice(0, last)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        whole, held = joined_batch(held), []
        yield whole


def joined_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the groups of a batch begin, and its end."""
    key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
    return np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [batch.num_rows]])


#: Groups up to this size are compared together, all pairs of a batch at once.
FEW = 8


def similar_links(tokens: np.ndarray, side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links that connect all candidate pairs of a group.

    Each node not yet connected is compared with all; nodes connected to
    different ones are then compared across.  With `side`, only pairs of
    different sides matter, but links within a side do no harm.
    """
    least = int(np.ceil(CANDIDATE * TOKENS))
    root, left, right = np.full(len(tokens), -1), [], []
    for k in range(len(tokens)):
        if root[k] < 0:
            near = np.flatnonzero((tokens == tokens[k]).sum(1) >= least)
            root[near[root[near] < 0]] = k
            left += [k] * (len(near) - 1)
            right += near[near != k].tolist()
    if root.max(initial=0) == 0:
        return left, right
    for k in range(len(tokens)):
        if root[k] != k:  # connected to another: its candidates elsewhere are not known yet
            apart = np.flatnonzero(root != root[k])
            near = apart[(tokens[apart] == tokens[k]).sum(1) >= least]
            left += [k] * len(near)
            right += near.tolist()
    return left, right


def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate links (a, b) from groups of rows (keys, node, tokens), each of bounded size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(CANDIDATE * TOKENS))
        for batch in groups(batches, len(keys)):
            node, tokens = batch.column("node").to_numpy(), tokens_of(batch.column("tokens"), np.uint16)
            start = bounds(batch, len(keys))
            size = np.diff(start)
            group = np.repeat(np.arange(len(size)), size)
            few = size[group] <= FEW
            left, right = [], []
            for d in range(1, FEW):
                at = np.flatnonzero((group[d:] == group[:-d]) & few[d:]) if len(group) > d else np.zeros(0, int)
                at = at[(tokens[at] == tokens[at + d]).sum(1) >= least]
                left.append(node[at])
                right.append(node[at + d])
            for g in np.flatnonzero(size > FEW):
                own = slice(start[g], start[g + 1])
                a, b = similar_links(tokens[own])
                links = joined_roots(int(size[g]), a, b)  # a link per node says the same
                left.append(node[own])
                right.append(node[own][links])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    dealt = rows.select(*keys, "node", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(make, "a long, b long")


def run_links(nodes: DataFrame, runs: range) -> DataFrame:
    """Candidate links of some runs."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array(short_tokens(tokens_of(batch.column(1), np.uint32)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), short], names=["node", "tokens"])

    short = nodes.select("node", "tokens").mapInArrow(shorten, "node long, tokens binary")
    few, many = shared_paths(first_paths(nodes, runs))
    few, many = (settled(x, "paths") for x in (few, many))
    out = [compared(few.join(short, "node"), ["path"])]
    depth, level = 1, many.join(short, "node")
    while not many.isEmpty():
        level = settled(compared_with_pivots(level), "pivots")
        out.append(level.where("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")))
        level = level.where(~F.col("leaves")).drop("to", "leaves")
        if depth == DEPTH:
            dealt = level.join(level.groupBy("path").agg(F.count("*").alias("size")).hint("merge"), "path")
            out.append(compared(block_pairs(dealt, F.ceil(F.col("size") / BLOCK)), ["path", "one", "two"]))
            break
        few, many = shared_paths(settled(split_paths(level), "paths"))
        many = settled(many, "paths")
        out.append(compared(few, ["path"]))
        depth, level = depth + 1, many
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return settled(links.distinct(), "candidates")


def audited_recall(nodes: DataFrame, connected: DataFrame) -> float:
    """The share of its partners that a drawn node is connected to, on average over those that have any.

    Partners agree in the share SIMILAR of tokens.  More nodes are drawn where
    few have partners, up to MOST_AUDITED.
    """
    size = AUDITED
    while True:
        recall, partnered = audit(nodes, connected, size)
        if partnered >= PARTNERED or size >= MOST_AUDITED:
            return recall
        size *= 4


def audit(nodes: DataFrame, connected: DataFrame, size: int) -> tuple[float, int]:
    """The average recall of `size` drawn nodes, and how many of them have partners."""
    audited = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(size).select("node", "tokens").collect()
    if len(audited) < 2:
        return 1.0, PARTNERED
    own = np.array([r["node"] for r in audited], np.int64)
    tokens = np.frombuffer(b"".join(r["tokens"] for r in audited), np.uint32).reshape(-1, TOKENS)
    least = int(np.ceil(SIMILAR[0] / SIMILAR[1] * TOKENS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, rows = batch.column(0).to_numpy(), tokens_of(batch.column(1), np.uint32)
            left, right = [], []
            for k in range(len(own)):
                near = np.flatnonzero((rows == tokens[k]).sum(1) >= least)
                left.append(np.full(len(near), own[k]))
                right.append(node[near])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    pairs = nodes.select("node", "tokens").mapInArrow(find, "a long, b long")
    for side in ("a", "b"):
        part = connected.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        pairs = pairs.join(part, side, "left")
    each = pairs.groupBy("a").agg(F.avg(F.coalesce(F.col("a_in") == F.col("b_in"), F.lit(False)).cast("int")).alias("found"))
    recall, n = each.agg(F.avg("found"), F.count("*")).first()
    return (recall if n else 1.0), n


def candidate_sets(nodes: DataFrame) -> DataFrame:
    """node and component of the nodes that runs have connected, repeated until the audit is passed."""
    links, run = None, 0
    while True:
        new = run_links(nodes, range(run, run + RUNS))
        links = new if links is None else links.unionByName(new)
        connected = settled(components(links), "connected")
        if audited_recall(nodes, connected) >= RECALL:
            return connected
        run += RUNS


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (the diagonal is not meant)."""
    m = len(sets)
    if m <= 3:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
    times = np.diff(start)
    number, often = np.repeat(np.arange(len(times)), times), np.repeat(times, times)
    out = np.zeros(m * m, np.int64)
    rare = often <= 32  # few owners: their pairs; many owners: a matrix product
    own, num = owner[rare], number[rare]
    for d in range(1, min(32, m)):
        at = np.flatnonzero(num[d:] == num[:-d]) if len(num) > d else np.zeros(0, int)
        if not len(at):
            break
        out += np.bincount(own[at] * m + own[at + d], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    own, num = owner[~rare], number[~rare]
    if len(num):
        column = np.unique(num, return_inverse=True)[1]
        for lo in range(0, int(column[-1]) + 1, 2048):
            part = (column >= lo) & (column < lo + 2048)
            has = np.zeros((m, 2048), np.float32)
            has[own[part], column[part] - lo] = 1
            out += np.rint(has @ has.T).astype(np.int64)
    return out


def exact_links(nodes: DataFrame, connected: DataFrame, docs: DataFrame) -> DataFrame:
    """node, links (documents of other nodes it is linked to) and root, from whole sets of windows.

    A node has a row per block pair it was compared in; `root` is a node it is
    connected to there, maybe itself.
    """
    sizes = nodes.select("node", "first_id", "text_hash", "copies", "n").join(connected, "node")
    totals = sizes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    members = sizes.join(totals, "component").drop("n")
    text = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text"))
    columns = ["component", "m", "total", "node", "copies", "text"]
    rows = members.join(text, "first_id").select(*columns)
    # Nodes that no document with an id has are fetched by their text; copies of it are put together first.
    nameless = members.where("first_id IS NULL").drop("first_id")
    texts = text.where("first_id IS NULL").select("text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(nameless.select("text_hash"), "text_hash", "left_semi").distinct()
    rows = rows.unionByName(nameless.join(texts, "text_hash").select(*columns))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Cache(word_hash, HASHES).__getitem__
        for batch in batches:
            sets, good = [], []
            for node, text in zip(batch.column(3).to_pylist(), batch.column(5), strict=True):
                own = windows((text.as_py() or "").encode("utf-8", "surrogatepass"), hashes)
                # An id that occurs with other texts brings those along; they are not this node's.
                good.append(len(own) > 0 and node_of(own) == node)
                sets.append(own.tobytes())
            columns = [*(batch.column(k) for k in range(5)), pa.array(sets, pa.binary())]
            names = ["component", "m", "total", "node", "copies", "windows"]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(good, pa.bool_()))

    rows = rows.mapInArrow(make, "component long, m long, total long, node long, copies long, windows binary")
    n_blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_WINDOWS))
    dealt = block_pairs(rows, n_blocks)
    keys = ["component", "one", "two"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(keys)):
            start = bounds(batch, len(keys))
            one, two, own = (batch.column(k).to_numpy() for k in ("one", "two", "own"))
            node, copies, raw = batch.column("node").to_numpy(), batch.column("copies").to_numpy(), batch.column("windows")
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in zip(start, start[1:]):
                at = lo + np.unique(node[lo:hi], return_index=True)[1]  # equal rows are one node
                sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in at]
                size = np.array([len(s) for s in sets])
                common = intersections(sets)
                similar = SIMILAR[1] * common >= SIMILAR[0] * (size[:, None] + size - common)
                np.fill_diagonal(similar, False)
                if one[lo] != two[lo]:
                    similar &= own[at][:, None] != own[at]
                a, b = np.nonzero(similar)
                out[0].append(node[at])
                out[1].append(similar @ copies[at])
                out[2].append(node[at][joined_roots(len(at), a[a > b], b[a > b])])
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])

    dealt = dealt.select(*keys, "own", "node", "copies", "windows").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(check, "node long, links long, root long")


def node_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node of every row; node, component, class_id, n_links of every node)."""
    rows = settled(document_nodes(docs), "ngram-rows")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("tokens").alias("tokens"),
    )
    nodes = settled(nodes, "ngram-nodes")
    found = settled(exact_links(nodes, candidate_sets(nodes), docs), "ngram-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = settled(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "ngram-classes")
    of = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(linked, "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("first_id").alias("class_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return rows.select("doc_id", "text_hash", "node"), of.join(least, "component").select("node", "component", "class_id", n_links)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_links and class_id (the smallest id among all documents reachable by links) of every row."""
    return row_classes(*node_classes(docs))


def row_classes(own: DataFrame, of: DataFrame) -> DataFrame:
    some = own.where("node IS NOT NULL").join(of, "node").select("doc_id", "n_links", "class_id")
    none = own.where("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return some.unionByName(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay when one document of each class does: that with the smallest id.

    Of equal rows one stays.  A document without an id stays only where no
    document of its class has one, and then one document per class.  Documents
    without words all stay.
    """
    own, of = node_classes(docs)
    of = settled(of, "ngram-of")
    keep = row_classes(own, of).where(F.col("doc_id") == F.col("class_id")).groupBy(F.col("doc_id").alias("_kept"))
    keep = settled(keep.agg(F.count("*").alias("_rows")), "ngram-kept")
    blank = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    full = docs.where(~blank & F.col("doc_id").isNotNull())
    same = full["doc_id"].cast("long") == keep["_kept"]
    single = full.join(keep.where("_rows = 1"), same, "left_semi")
    # Only ids that occur again, which is rare, have their texts compared.
    again = full.join(keep.where("_rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    # The same for classes of nothing but documents without an id: the smallest node's smallest text.
    first = of.where("class_id IS NULL").groupBy("component").agg(F.min("node").alias("node"))
    first = own.where("doc_id IS NULL").join(first, "node").groupBy("node").agg(F.min("text_hash").alias("_hash"))
    nameless = docs.where(~blank & F.col("doc_id").isNull())
    nameless = nameless.join(first.select("_hash"), F.xxhash64(nameless["text"].cast("string")) == first["_hash"], "left_semi")
    return single.unionByName(again).unionByName(nameless.dropDuplicates(["text"])).unionByName(docs.where(blank)).select(*docs.columns)
