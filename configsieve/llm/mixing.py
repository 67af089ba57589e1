"""Mixing sources to target weights with fixed-length blocks of words.

The documents of a source, in a pseudorandom order, form one stream of words
that is cut into blocks of `block` words.  Each output shard draws multinomial
block counts over the sources, given each source's total, so that the totals
come out exactly.  The k-th slot of a source takes the block at index k of a
pseudorandom permutation of its blocks (one permutation per pass), and slots
meet their blocks in a join by (source, block).  The last slot of a source is
cut so that its words end at the target.

Everything is a function of the rows and the seed, so reruns agree.

Edge cases: a null or blank text has no words and is never taken; a null source
is a source of its own, ordered last; a source without words has target 0;
repeated rows take places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from configsieve.llm.storage import settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK = 128
SHARDS = 64
SEED = 20_260
#: Documents of a source that one task puts in order.
ORDER_ROWS = 2_000
#: Slots that one row stands for before they are dealt out.
SLOT_ROWS = 1 << 15


class Permutation:
    """A pseudorandom permutation of 0 .. n-1 that is computed, not stored.

    A four-round Feistel network over the next even number of bits; values of n
    or more are sent through again until they fall below n.
    """

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(1, 1 << 62, 4).astype(np.uint64) | np.uint64(1)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= key
        return (x >> np.uint64(31)) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << shift) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x).astype(np.uint64), keys, back)
            while (outside := out >= self.n).any():
                out[outside] = self._once(out[outside], keys, back)
        return out.astype(np.int64)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys, False)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys[::-1], True)


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Words due to each source: by weight, none above `most` times its size.

    What a full source cannot take is shared again by weight among the others.
    """
    weight = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    caps = [float(most) * size for size in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * unit > caps[k]}
        if not full:
            for k in open_:
                out[k] = weight[k] * unit
            break
        for k in full:
            out[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return out


@dataclasses.dataclass(frozen=True)
class Source:
    """What one source gives: `slots` draws, `passes` of them whole, the last cut to `last_take` words."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_take: int


def permutation(source: int, blocks: int, turn: int, seed: int = SEED) -> Permutation:
    return Permutation(blocks, seed * 1_000_003 + source * 101 + turn)


def plan_source(number: int, name: str | None, size: int, target: float, block: int, seed: int = SEED) -> Source:
    blocks = -(-size // block)
    if not blocks:
        return Source(number, name, size, target, 0, 0, 0)
    words = round(target)
    passes, rest = divmod(words, size)
    short = size - (blocks - 1) * block  # words of the last block
    if not rest:
        last = int(permutation(number, blocks, passes - 1, seed).index(np.array([blocks - 1]))[0]) if passes else 0
        return Source(number, name, size, target, blocks, passes * blocks, short if last == blocks - 1 else block)
    at = int(permutation(number, blocks, passes, seed).slot(np.array([blocks - 1]))[0])
    slots = -(-rest // block)
    if at < slots:  # the short block is among them
        slots = -(-(rest + block - short) // block)
    have = slots * block - (block - short if at < slots else 0)
    last = short if at == slots - 1 else block
    return Source(number, name, size, target, blocks, passes * blocks + slots, last - (have - rest))


def shard_counts(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Block counts per (shard, source): multinomial draws whose sums over the shards are `slots`.

    Shards have equally many blocks, to one.  A shard draws with the odds of
    what is left of each source; a draw beyond what is left goes to the
    sources that have most left.
    """
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for shard in range(shards - 1):
        total = int(left.sum())
        size = total // (shards - shard)
        if not size:
            continue
        draw = np.minimum(rng.multinomial(size, left / total), left)
        while lacking := size - int(draw.sum()):
            k = int(np.argmax(left - draw))
            draw[k] += min(lacking, int(left[k] - draw[k]))
        out[shard] = draw
        left -= draw
    out[-1] = left
    return out


@dataclasses.dataclass(frozen=True)
class Mixture:
    """`documents`: the input with source_number, size, source_size, target and start (its place in the
    source's stream); `slots`: shard, slot, source_number, block, draw (which of the source's passes) and
    take (words taken from the block's start)."""

    documents: DataFrame
    slots: DataFrame
    sources: list[Source]
    block: int


def located(docs: DataFrame, sources: list[Source], counts: dict[int, int]) -> DataFrame:
    """The rows with their place in the stream of their source.

    A source may hold a third of all rows: its rows are dealt to buckets of
    about ORDER_ROWS by a hash, and a place is the words of the buckets before
    plus those before in the bucket.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(s.number, s.name, s.size, s.target, -(-counts[s.number] // ORDER_ROWS)) for s in sources],
        "source_number int, source_name string, source_size long, target double, n_buckets long",
    )
    # One row per source, each of which has a weight: joined without dealing rows by source.
    dealt = docs.join(F.broadcast(known), docs["_source"].eqNullSafe(known["source_name"])).drop("source_name")
    dealt = dealt.withColumn("_bucket", F.pmod("_key", "n_buckets"))
    before = Window.partitionBy("source_number").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source_number", "_bucket").agg(F.sum("_size").alias("_n"))
    bases = sums.select("source_number", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source_number", "_bucket").orderBy("_key", "_id", "_size", *ROW)
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    # Dealt by both columns: a join could else reuse the window's dealing by source alone.
    joined = dealt.join(bases.repartition("source_number", "_bucket"), ["source_number", "_bucket"])
    return joined.withColumn("_start", F.col("_base") + F.col("_before")).drop("_bucket", "_base", "_before", "n_buckets", "_key")


def slot_table(spark, sources: list[Source], block: int, shards: int, seed: int = SEED) -> DataFrame:
    """One row per slot of the mixture, made where they are needed from a few rows per shard and source."""
    counts = shard_counts([s.slots for s in sources], shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    offsets = np.cumsum(counts, axis=1) - counts
    spans = [
        (shard, s.number, s.blocks, int(first[shard, k]), int(counts[shard, k]), int(offsets[shard, k]),
         s.slots - 1, s.last_take, s.size - (s.blocks - 1) * block)
        for shard in range(shards) for k, s in enumerate(sources) if counts[shard, k]
    ]
    rows = spark.createDataFrame(
        spans,
        "shard int, source_number int, blocks long, first long, n long, offset long, last long, last_take long, short long",
    )
    parts = rows.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_ROWS).cast("long"))))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k = np.arange(r["lo"], min(r["lo"] + SLOT_ROWS, r["n"]))
                draw = r["first"] + k
                turn, index = draw // r["blocks"], draw % r["blocks"]
                for t in np.unique(turn):
                    own = turn == t
                    index[own] = permutation(r["source_number"], r["blocks"], int(t), seed).index(index[own])
                take = np.where(index == r["blocks"] - 1, r["short"], block)
                take = np.where(draw == r["last"], np.minimum(take, r["last_take"]), take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), r["shard"], np.int32)), pa.array(r["offset"] + k),
                     pa.array(np.full(len(k), r["source_number"], np.int32)), pa.array(index),
                     pa.array(turn.astype(np.int32)), pa.array(take.astype(np.int64))],
                    names=["shard", "slot", "source_number", "block", "draw", "take"],
                )

    schema = "shard int, slot long, source_number int, block long, draw int, take long"
    return parts.repartition(F.col("shard"), F.col("source_number"), F.col("lo")).mapInArrow(slots, schema)


#: The two hashes that a row is known by.
ROW = ("_row", "_row_again")


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a row, 128 bits together; rows are equal where both are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns), F.xxhash64(F.lit("again"), *reversed(columns))]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS,
        block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> Mixture:
    """The mixture of all documents.

    The number of sources is taken to be small (a weight is set for each); one
    row per source comes to the driver.
    """
    narrow = settled(docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.col("source").cast("string").alias("_source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_key"),
        *(key.alias(name) for key, name in zip(row_keys(docs), ROW, strict=True)),
    ), "mix-rows")
    found = narrow.groupBy("_source").agg(F.sum("_size"), F.count("*")).collect()
    # Code points order as UTF-8 bytes do, and as Python strings do.
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    due = targets([r[1] for r in found], weights, share, most)
    sources = [plan_source(k, r[0], r[1], t, block, seed) for k, (r, t) in enumerate(zip(found, due, strict=True))]
    rows = located(narrow, sources, {k: r[2] for k, r in enumerate(found)})
    # Written, so that joins go by the size it has: planned from a few rows, it would be broadcast.
    slots = settled(slot_table(docs.sparkSession, sources, block, shards, seed), "mix-slots")
    return Mixture(settled(rows, "mix-places"), slots, sources, block)


def taken_parts(mixture: Mixture) -> DataFrame:
    """source_number, _start (together the key of a document), shard, slot, draw, and the words [lo, hi) of
    the document that the slot takes; documents nothing is taken of have null."""
    block = F.lit(mixture.block).cast("long")
    rows = mixture.documents.where("_size > 0").select("source_number", "_start", "_size")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block)
    cut = rows.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = F.col("block") * block
    joined = cut.join(mixture.slots, ["source_number", "block"], "left")
    lo = F.greatest(F.col("_start"), at) - F.col("_start")
    # least() skips nulls, so a block without a slot is told apart here.
    hi = F.when(F.col("take").isNotNull(), F.least(F.col("_start") + F.col("_size"), at + F.col("take")) - F.col("_start"))
    return joined.select("source_number", "_start", "shard", "slot", "draw", lo.alias("lo"), hi.alias("hi"))


def taken_words(mixture: Mixture) -> DataFrame:
    """Per document: _id, _size, source_size, target and taken, the words that the mixture takes of it."""
    words = F.greatest(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(0))
    sums = taken_parts(mixture).groupBy("source_number", "_start").agg(F.sum(words).alias("taken"))
    own = mixture.documents
    some = own.where("_size > 0").join(sums, ["source_number", "_start"])
    none = own.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ("_id", "_size", "source_size", "target", "taken")
    return some.select(*columns).unionByName(none.select(*columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents with the columns of the input.

    A document appears once for each pass that takes any of its words, with the
    text that is taken: whole, or the parts in their order joined by a blank.
    """
    columns = docs.columns
    mixture = mix(docs, **options)
    parts = taken_parts(mixture).where("hi > lo").groupBy("source_number", "_start", "draw")
    spans = parts.agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
    places = mixture.documents.where("_size > 0").select("source_number", "_start", "_size", *ROW)
    repeated = places.groupBy(*ROW).agg(F.count("*").alias("_rows"))
    taken = places.join(spans, ["source_number", "_start"]).join(repeated, list(ROW)).select(*ROW, "_size", "_spans", "_rows")
    taken = settled(taken, "mix-taken")
    # Texts move once, to meet what is taken of them.  Of equal rows, which are rare, one stands for all.
    texts = docs.select(
        *(F.col(f"`{c}`").alias(f"_kept_{c}") for c in columns), *(key.alias(name) for key, name in zip(row_keys(docs), ROW, strict=True))
    )
    single = texts.join(taken.where("_rows = 1"), list(ROW))
    copies = texts.join(taken.where("_rows > 1").select(*ROW).distinct(), list(ROW), "left_semi").dropDuplicates(list(ROW))
    again = copies.join(taken.where("_rows > 1"), list(ROW))
    rows = single.unionByName(again)
    place = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            texts = []
            for text, size, spans in zip(batch.column(place), batch.column("_size"), batch.column("_spans"), strict=True):
                runs: list[list[int]] = []
                for span in spans.as_py():
                    if runs and runs[-1][1] == span["lo"]:
                        runs[-1][1] = span["hi"]
                    else:
                        runs.append([span["lo"], span["hi"]])
                text = text.as_py()
                if runs != [[0, size.as_py()]]:
                    at = [m.span() for m in word.finditer(text)]
                    text = " ".join(text[at[lo][0] : at[hi - 1][1]] for lo, hi in runs)
                texts.append(text)
            own = [batch.column(k) for k in range(len(columns))]
            own[place] = pa.array(texts, own[place].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)

    return rows.select(*(f"`_kept_{c}`" for c in columns), "_size", "_spans").mapInArrow(cut, docs.schema)
