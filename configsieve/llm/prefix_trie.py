"""The trie of conversation beginnings, from sorted sequences and range minima.

Conversations are sequences of turns (role, text); every distinct beginning is a
node.  Sequences are sorted, so the members of a node are an interval of rows.
The common beginnings of neighbouring rows (LCPs) go into a sparse table of
range minima; each candidate beginning then searches its left and its right end
by halving steps over that table, alone, without a stack or an order among
candidates.  What a node adds up over its subtree is again an interval: each
node belongs to its smallest member, and a node's subtree is all that its
members own, less what its own smallest member owns above it.

What bounds a task: a conversation may be of any length and a beginning may be
common to all.  Turns are numbered by sorted ranges, not per conversation;
sequences are cut into bands of BAND turns, sorted by (band, what came before,
turns, id), so a conversation is many short rows; ranges of about SORTED_ROWS
rows are searched on their own, and only intervals that touch a range's edge are
put together afterwards.  A beginning is known by the xor of two 64-bit hashes of
each (place, turn), which can be summed in parts.

Edge cases: a null role or text is empty; turns of equal number are ordered by a
hash; null turns come first; a row without conv_id belongs to no conversation;
equal rows are turns of their own; conversations without turns are members of
the root; a family is FAMILY ids from a multiple of it on, below 0 too; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from configsieve.llm.storage import settled

#: Turns of a conversation in one row.
BAND = 64
#: Rows of a sorted range, about.
SORTED_ROWS = 32_768
#: Ids that are joined to one piece of text.
PIECE_IDS = 8_192
#: Conversations that share a head, and the most turns of it.
FAMILY, HEADS = 20, 4
#: monotonically_increasing_id has the partition above these bits.
PART_BITS = 33
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, two hashes x and y of role and text, and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("turn"), text, role).alias("y"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return rows.where("conv IS NOT NULL")


def placed_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, x, y, words) with places from 1 in order of turn, and (conv, n).

    The rows are sorted in ranges; a place is the row's number in its range plus
    the conversation's rows in the ranges before.
    """
    order = ["conv", "turn", "x", "y"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settled(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted-turns")
    ranged = ranged.withColumn("part", F.shiftright("at", PART_BITS))
    stretches = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    place = (F.col("base") + F.col("at") - F.col("first") + 1).alias("place")
    placed = ranged.join(stretches, ["conv", "part"]).select("conv", place, "x", "y", "words")
    return placed, stretches.groupBy("conv").agg(F.sum("m").alias("n"))


def rebuilt(placed: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv, depth, x, y, words) and all conversations (conv, size).

    A conversation's first turns are replaced by as many of its family's first
    conversation: crc32 of its id, modulo HEADS.
    """
    head = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    wanted = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("wanted")
    firsts = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("head"), F.col("n").alias("n_head"))
    plan = convs.select("conv", "n", head.alias("head"), wanted).join(firsts, "head", "left")
    taken = F.least("wanted", F.coalesce("n_head", F.lit(0))).cast("long")
    plan = settled(plan.select("conv", "n", "head", "wanted", taken.alias("taken")), "rebuild-plan")
    heads = placed.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEADS))
    heads = heads.select(F.col("conv").alias("head"), "place", "x", "y", "words")
    front = plan.join(heads, "head").where("place <= taken").select("conv", F.col("place").alias("depth"), "x", "y", "words")
    own = placed.join(plan, "conv").where("place > wanted")
    own = own.select("conv", (F.col("taken") + F.col("place") - F.col("wanted")).alias("depth"), "x", "y", "words")
    size = F.col("taken") + F.greatest(F.col("n") - F.col("wanted"), F.lit(0))
    return front.unionByName(own), plan.select("conv", size.alias("size"))


def xor_before(rows: DataFrame, *columns: str) -> list[Column]:
    window = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.bit_xor(c).over(window), F.lit(0)).alias(f"start_{c}") for c in columns]


def banded(turns: DataFrame) -> DataFrame:
    """conv, band, start_a, start_b (hash of all bands before), keys (a, b of each turn), words of each turn, a, b."""
    hashed = turns.select(
        "conv", "depth", F.floor((F.col("depth") - 1) / BAND).cast("long").alias("band"), "words",
        F.xxhash64("depth", "x", "y").alias("a"), F.xxhash64(F.lit("at"), "y", "depth", "x").alias("b"),
    )
    one = F.struct("depth", "a", "b", "words")
    # A band holds at most BAND turns.
    rows = hashed.groupBy("conv", "band").agg(F.sort_array(F.collect_list(one)).alias("turns"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    rows = settled(rows.select(
        "conv", "band", "a", "b", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("keys"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    ), "bands")
    # Only conversations of several bands have anything before a band.
    narrow = rows.select("conv", "band", "a", "b")
    starts = narrow.select("conv", "band", *xor_before(narrow, "a", "b")).where("band > 0")
    joined = rows.join(starts, ["conv", "band"], "left")
    return joined.fillna(0, ["start_a", "start_b"])


ORDER = ["band", "start_a", "start_b", "keys", "conv"]


def in_ranges(bands: DataFrame) -> DataFrame:
    """The band rows, sorted in ranges of about SORTED_ROWS."""
    ranges = max(bands.count() // SORTED_ROWS + 1, int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bands.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of the 2^k values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share `depth` turns with each candidate's row.

    `lcp[i]` is what row i shares with the row before.  Every candidate halves
    its steps on its own.
    """
    levels, left, right = sparse_table(lcp), row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, low = 1 << k, levels[k]
        ahead = right + 1 <= len(low) - 1
        ahead[ahead] = low[right[ahead] + 1] >= depth[ahead]
        right[ahead] += step
        back = left - step + 1 >= 0
        back[back] = low[left[back] - step + 1] >= depth[back]
        left[back] -= step
    return left, right


def least_between(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of the values from `left` to `right`, both included."""
    out = np.empty(len(left), dtype=levels[0].dtype)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][left[at]], levels[k][right[at] - (1 << k) + 1])
    return out


INTERVALS = (
    "a long, b long, depth long, parent_a long, parent_b long, n_convs long, conv_id long, words long, edge boolean, total long, leaves long"
)


def interval_table(rows: pa.Table) -> pa.RecordBatch | None:
    """The distinct beginnings of one sorted range, with their interval (see INTERVALS).

    `edge`: the interval reaches the range's first or last row, so it may go on beyond.
    """
    n = rows.num_rows
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    band, start_a, start_b, conv, saved, leaves = (column[c].to_numpy() for c in ("band", "start_a", "start_b", "conv", "saved", "leaves"))
    offset = column["words"].offsets.to_numpy().astype(np.int64)
    keys = column["keys"].flatten().to_numpy().reshape(-1, 2)
    words = column["words"].flatten().to_numpy()
    offset, size = offset[:-1] - offset[0], np.diff(offset)
    if not len(words):
        return None
    row = np.repeat(np.arange(n), size)
    depth = np.arange(len(row)) - offset[row] + 1
    hashes = []
    for k, start in enumerate((start_a, start_b)):
        running = np.bitwise_xor.accumulate(keys[:, k])
        before = np.concatenate([[0], running])[offset]
        hashes.append(running ^ (before ^ start)[row])
    ha, hb = hashes
    # What each row shares with the row before, turn by turn.
    lcp = np.zeros(n, dtype=np.int64)
    alive = np.zeros(n, dtype=bool)
    alive[1:] = (band[1:] == band[:-1]) & (start_a[1:] == start_a[:-1]) & (start_b[1:] == start_b[:-1])
    for k in range(BAND):
        at = np.flatnonzero(alive)
        at = at[(size[at] > k) & (size[at - 1] > k)]
        here, there = offset[at] + k, offset[at - 1] + k
        at = at[(ha[here] == ha[there]) & (hb[here] == hb[there])]
        if not len(at):
            break
        lcp[at] += 1
        alive = np.zeros(n, dtype=bool)
        alive[at] = True
    left, right = extents(lcp, row, depth)
    new = left == row
    left, right, depth, at = left[new], right[new], depth[new], np.flatnonzero(new)
    parent = [np.where(depth > 1, h[at - 1], start[left]) for h, start in ((ha, start_a), (hb, start_b))]
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (saved, leaves)]
    out = {
        "a": ha[at], "b": hb[at], "depth": depth + band[left] * BAND, "parent_a": parent[0], "parent_b": parent[1],
        "n_convs": right - left + 1, "conv_id": least_between(sparse_table(conv), left, right), "words": words[at],
        "edge": (left == 0) | (right == n - 1), "total": sums[0][right + 1] - sums[0][left], "leaves": sums[1][right + 1] - sums[1][left],
    }
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in out.items()})


def intervals(bands: DataFrame) -> DataFrame:
    """All beginnings but the root (see INTERVALS, without `edge`); `total` and `leaves` add up saved and leaves of the rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        found = interval_table(pa.Table.from_batches(held)) if held else None
        if found is not None:
            yield from (found.slice(lo, 10_000) for lo in range(0, found.num_rows, 10_000))

    found = settled(in_ranges(bands).mapInArrow(search, INTERVALS), "intervals")
    keys = ["a", "b", "depth", "parent_a", "parent_b"]
    # At most BAND beginnings reach across each edge of a range.
    across = found.where("edge").groupBy(*keys).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"),
        F.sum("total").alias("total"), F.sum("leaves").alias("leaves"),
    )
    return found.where("NOT edge").drop("edge").unionByName(across)


def sha_of_ids(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of the ascending comma-joined ids (conv) of each (a, b).

    Ids are joined to pieces in sorted ranges.  A hash has to go through its
    pieces in order, so the pieces of a key that has several meet in one task,
    which holds one piece at a time.
    """
    empty = {"a": pa.int64(), "b": pa.int64(), "first": pa.int64(), "ids": pa.string(), "sha": pa.string()}

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([] for _ in empty)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, empty.values(), strict=True)], names=list(empty))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, whole = None, [], False
        out: list[tuple] = []
        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv")), strict=True):
                if (a, b) != key or len(ids) == PIECE_IDS:
                    if ids:
                        out.append((*key, ids, whole and (a, b) != key))
                    # The first key of a range may have begun before; the last may go on.
                    whole = key is not None and (a, b) != key
                    key, ids = (a, b), []
                ids.append(conv)
            yield as_batch([piece(*x) for x in out])
            out = []
        if ids:
            yield as_batch([piece(*key, ids, False)])

    def piece(a: int, b: int, ids: list[int], whole: bool) -> tuple:
        text = ",".join(map(str, ids))
        return (a, b, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if whole else (a, b, ids[0], text, None)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, None, None, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield as_batch(out)
        if key is not None:
            yield as_batch([(*key, None, None, state.hexdigest())])

    schema = "a long, b long, first long, ids string, sha string"
    ranged = ends.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = settled(ranged.mapInArrow(join, schema), "id-pieces")
    several = pieces.where("sha IS NULL").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return pieces.where("sha IS NOT NULL").unionByName(several.mapInArrow(digest, schema)).select("a", "b", F.col("sha").alias("ends_sha256"))


def saved_above(nodes: DataFrame) -> DataFrame:
    """The nodes with `above`: what their smallest member's own nodes above them save.

    Summed within bands and over bands, so a long conversation is not one group.
    """
    nodes = nodes.withColumn("band", F.floor((F.col("depth") - 1) / BAND).cast("long"))
    within = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("here", F.coalesce(F.sum("saved").over(within), F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = nodes.groupBy("conv_id", "band").agg(F.sum("saved").alias("all"))
    totals = totals.select("conv_id", "band", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("earlier")).where("earlier > 0")
    joined = nodes.join(totals, ["conv_id", "band"], "left")
    return joined.withColumn("above", F.col("here") + F.coalesce("earlier", F.lit(0))).drop("band", "here", "earlier")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(*placed_turns(turn_rows(conversations)))
    bands = settled(banded(turns), "sorted-bands")
    zero = F.lit(0).cast("long")

    # The nodes, and what each is worth.
    found = intervals(bands.withColumns({"saved": zero, "leaves": zero})).drop("total", "leaves")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(
        zero.alias("a"), zero.alias("b"), zero.alias("depth"), none.alias("parent_a"), none.alias("parent_b"), "n_convs", "conv_id", zero.alias("words")
    )
    nodes = found.unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = settled(nodes, "nodes")

    # What the smallest members own, added up over each node's members.
    worth = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    worth = settled(worth.withColumnRenamed("conv_id", "conv"), "worth")
    # A conversation's nodes are below all its bands alike, so its worth counts once in each of them.
    valued = bands.join(worth, "conv", "left").fillna(0, ["saved", "leaves"])
    sums = intervals(valued).select("a", "b", "total", "leaves")
    of_root = worth.agg(F.sum("saved").alias("total"), F.sum("leaves").alias("leaves")).where("leaves IS NOT NULL")
    sums = sums.unionByName(of_root.select(zero.alias("a"), zero.alias("b"), "total", "leaves"))

    last = bands.join(convs, "conv").where(F.col("band") * BAND + F.size("words") == F.col("size"))
    ends = last.select("conv", F.col("start_a").bitwiseXOR(F.col("a")).alias("a"), F.col("start_b").bitwiseXOR(F.col("b")).alias("b"))
    ends = ends.unionByName(convs.where("size = 0").select("conv", zero.alias("a"), zero.alias("b")))

    parents = nodes.where("n_children > 0").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    rows = saved_above(nodes).join(sums, ["a", "b"]).join(sha_of_ids(ends), ["a", "b"], "left")
    rows = rows.join(parents, ["parent_a", "parent_b"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
