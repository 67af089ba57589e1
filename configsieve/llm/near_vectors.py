"""Near-duplicate embeddings: small-world graphs per shard, exact cosines, components.

Vectors are dealt to shards by hash; each shard builds a navigable small-world
graph.  Every vector is searched for in every shard.  A shard audits itself:
sampled vectors are compared with all of the shard, and the beam is widened
until the target share of their links is found.  A beam that ends full of
links is widened for its vector alone, so a vector may have any number of links.
What is found counts if its cosine in double precision is high enough.

A pair may be found from one side only and counts for both ends: what a search
found leaves it as pairs, which are then made distinct.  A vector with a full beam
of links in a shard is wide: its links are not written out.  They are counted
exactly within its component, in pairs of blocks, and leave a task as one row per
vector.  So pairs are at most a beam per vector and shard, and all pairs are only
compared where one of the two is wide.

A graph travels in pieces: a row with all of it would be held as often as there
are tasks that search it.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing; equal vectors are searched for once and count as
links of each other; vectors of different lengths never link; repeated rows
count as vectors of their own; vectors without vec_id link like others, their
component has the least id there is, or null, and they are kept where it is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from configsieve.llm.components import components, joined_roots
from configsieve.llm.ngram_join import block_pairs, bounds, groups
from configsieve.llm.small_world import SIDE_BY_SIDE, SmallWorld
from configsieve.llm.storage import settled, small_bytes

LEAST_COSINE = 0.9
#: Shards at least, and vectors of a shard, about.
SHARDS = 6
SHARD_ROWS = 65_536
#: Bytes of a shard's vectors, about: long vectors make more shards.
SHARD_BYTES = 64 << 20
#: Vectors that one task searches a shard for, about; more where they are fewer bytes than the shard's graph.
SEARCH_ROWS = 32_768
#: Bytes of a piece of a graph, and pieces in a file: a file's are read together.
PIECE_BYTES = 64 << 10
FILE_PIECES = 128
BEAM = 16
AUDITED = 256
RECALL = 0.99
#: Vectors of a block at least, how its size grows with the root of the component's, and bytes at most.
BLOCK = 256
BLOCK_GROWTH = 8
BLOCK_BYTES = 16 << 20
#: Tasks of a search at most.
TASKS = 100_000
#: What single precision may be off by.
SLACK = 1e-4


def vector_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as bytes of doubles; null where it can't link."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for vector in batch.column(1):
                values = vector.as_py()
                own = np.array([np.nan if v is None else v for v in values or ()], np.float64)
                good = len(own) and np.isfinite(own).all() and own.any()
                # Scaled first: squares of very large or small components would leave the range of doubles.
                own = own / np.abs(own).max() if good else own
                raw.append((own / np.linalg.norm(own) + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    out = rows.mapInArrow(make, "vec_id long, unit binary")
    return out.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))


def dealt_evenly(rows: DataFrame, number: Column, tasks: int) -> DataFrame:
    """Rows of the same `number` and length in one task, numbers one after the other.

    By hash, some tasks would get several shards and others none.
    """
    return rows.repartitionById(tasks, F.pmod(number + F.xxhash64("length"), F.lit(tasks)).cast("int"))


def unit_rows(raw: pa.Array) -> np.ndarray:
    """The vectors of a column without nulls whose bytes are equally many; not copied."""
    ends = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32)
    lo, hi = int(ends[raw.offset]), int(ends[raw.offset + len(raw)])
    return np.frombuffer(raw.buffers()[2], np.float64, (hi - lo) // 8, lo).reshape(len(raw), -1)


def in_pieces(index: dict) -> Iterator[bytes]:
    """The index of a shard as bytes of PIECE_BYTES at most, apart from the first, which says what the others are."""
    arrays: list[pickle.PickleBuffer] = []
    head = pickle.dumps(index, protocol=5, buffer_callback=arrays.append)
    raw = [array.raw() for array in arrays]
    yield pickle.dumps((head, [part.nbytes for part in raw]))
    for part in raw:
        for lo in range(0, part.nbytes, PIECE_BYTES):
            yield bytes(part[lo : lo + PIECE_BYTES])


class Pieces:
    """Takes the pieces of an index in their order; `index` puts it together, its arrays without another copy."""

    def __init__(self) -> None:
        self.head, self.arrays, self.at = None, [], [0, 0]

    def add(self, piece: bytes) -> None:
        if self.head is None:
            self.head, sizes = pickle.loads(piece)
            self.arrays = [bytearray(size) for size in sizes]
            return
        while self.at[1] == len(self.arrays[self.at[0]]):
            self.at = [self.at[0] + 1, 0]
        array, lo = self.at
        self.arrays[array][lo : lo + len(piece)] = piece
        self.at[1] += len(piece)

    def index(self) -> dict:
        return pickle.loads(self.head, buffers=self.arrays)


def built(nodes: DataFrame, shards: int) -> DataFrame:
    """The pieces of each shard: the graph, its vectors and the beam that passed the audit."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 2):
            start = bounds(batch, 2)
            for lo, hi in zip(start, start[1:]):
                part = batch.slice(lo, hi - lo)
                unit = unit_rows(part.column("unit"))
                graph = SmallWorld(unit)
                index = {
                    "unit": unit, "node": part.column("node").to_numpy(), "copies": part.column("copies").to_numpy(),
                    "layers": graph.members_only(), "order": graph.order, "beam": audited_beam(graph),
                }
                keys = [part.column(k)[0].as_py() for k in (0, 1)]
                for piece, raw in enumerate(in_pieces(index)):
                    row = [pa.array([k], pa.int64()) for k in (*keys, piece)]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([raw], pa.binary())], names=["length", "shard", "piece", "index"])

    rows = nodes.select("length", "shard", "node", "copies", "unit")
    dealt = dealt_evenly(rows, F.col("shard"), shards).sortWithinPartitions("length", "shard", "node")
    return dealt.mapInArrow(build, "length long, shard long, piece long, index binary")


def audited_beam(graph: SmallWorld) -> int:
    """The beam, doubled until it finds RECALL of the links of each of two kinds of vectors, on average.

    One kind are sampled vectors of the shard that have links to others in it.
    There may be few, as partners are mostly in other shards; the other kind are
    therefore drawn partners of sampled vectors, as another shard could hold them.
    """
    n, beam = len(graph.unit), BEAM
    rng = np.random.default_rng(3)
    sample = rng.choice(n, min(n, AUDITED), replace=False)
    unit = graph.unit[sample]
    aside = rng.normal(size=unit.shape).astype(np.float32)
    aside -= (aside * unit).sum(1, keepdims=True) * unit
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-6)
    cosine = rng.uniform(LEAST_COSINE, 1, (len(sample), 1)).astype(np.float32)
    partners = cosine * unit + np.sqrt(1 - cosine**2) * aside
    partners /= np.linalg.norm(partners, axis=1, keepdims=True)
    kinds = []
    for queries, own in ((unit, sample), (partners, None)):
        true = np.stack([q @ graph.unit.T >= LEAST_COSINE for q in queries])
        if own is not None:
            true[np.arange(len(own)), own] = False
        linked = true.any(1)
        if linked.any():
            kinds.append((queries[linked], true[linked]))
    while beam < n and any(mean_recall(graph, *kind, beam) < RECALL for kind in kinds):
        beam *= 2
    return min(beam, n)


def mean_recall(graph: SmallWorld, queries: np.ndarray, true: np.ndarray, beam: int) -> float:
    """The share of its true links (a row of `true`) that a vector finds, on average."""
    row, at = graph.within(queries, LEAST_COSINE - SLACK, beam)
    return float((np.bincount(row, weights=true[row, at], minlength=len(queries)) / true.sum(1)).mean())


def searched(nodes: DataFrame, indexes: DataFrame, parts: int, shards: int) -> DataFrame:
    """node, root (a node it is connected to) and kind of each find: see `found_links`.

    Each shard is searched by `parts` tasks, and each task gets the pieces of the
    shard's index, in their order, before the vectors to search for.
    """
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    one = indexes.withColumn("part", every).withColumn("kind", F.lit(0)).withColumn("node", F.lit(None).cast("long"))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.lit(parts))
    all_shards = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    rows = nodes.select("length", part.alias("part"), F.lit(1).alias("kind"), "node", F.col("unit").alias("index"), all_shards.alias("shard"))
    rows = rows.withColumn("piece", F.lit(0).cast("long"))
    keys = ["length", "shard", "part"]
    columns = [*keys, "kind", "node", "index", "piece"]
    both = one.select(*columns).unionByName(rows.select(*columns))
    number = F.col("shard") * parts + F.col("part")
    dealt = dealt_evenly(both, number, min(shards * parts, TASKS)).sortWithinPartitions(*keys, "kind", "piece")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, index, graph = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            start = bounds(batch, 4)
            for lo, hi in zip(start, start[1:]):
                own = tuple(batch.column(k)[int(lo)].as_py() for k in range(3))
                if batch.column(3)[int(lo)].as_py() == 0:
                    if own != key:
                        key, pieces, index, graph = own, Pieces(), None, None
                    for k in range(lo, hi):
                        pieces.add(batch.column(5)[k].as_py())
                elif own == key:  # else the shard is empty
                    if graph is None:
                        index, pieces = pieces.index(), None
                        graph = SmallWorld(index["unit"], SmallWorld.whole_layers(index["layers"], index["order"]), index["order"])
                    unit = unit_rows(batch.column(5).slice(lo, hi - lo))
                    yield found_links(graph, index, batch.column(4).slice(lo, hi - lo).to_numpy(), unit)

    return dealt.mapInArrow(search, "node long, root long, kind int")


#: Kinds of finds: a node connected to another, a linked pair, a node that is wide.
CONNECTED, PAIR, WIDE = range(3)


def found_links(graph: SmallWorld, index: dict, node: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
    """What the shard holds for each vector: its pairs, or, for wide ones, what connects them and a row that says so."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    joined, wide = [(left[0], right[0])], np.zeros(len(node), bool)
    for lo in range(0, len(node), SIDE_BY_SIDE):
        own = slice(lo, lo + SIDE_BY_SIDE)
        row, at = close_pairs(graph, index, node[own], unit[own])
        wide[own] = np.bincount(row, minlength=len(node[own])) >= BEAM
        many = wide[own][row]
        one, two = node[own][row], index["node"][at]
        left.append(one[~many])
        right.append(two[~many])
        joined.append(named_roots(one[many], two[many]))
    # What a few vectors connect may be connected again by others.
    names, roots = named_roots(*map(np.concatenate, zip(*joined)))
    left, right = [names, *left, node[wide]], [roots, *right, node[wide]]
    kinds = np.repeat([CONNECTED, PAIR, WIDE], [len(names), sum(map(len, left)) - len(names) - wide.sum(), wide.sum()])
    columns = [pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64()), pa.array(kinds, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "root", "kind"])


def close_pairs(graph: SmallWorld, index: dict, node: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of `unit` and place in the shard of the found vectors that are close enough in double precision, but for the row's own."""
    row, at = graph.within(unit.astype(np.float32), LEAST_COSINE - SLACK, index["beam"])
    good = np.zeros(len(row), bool)
    step = max(1, BLOCK_BYTES // (8 * unit.shape[1]))
    for lo in range(0, len(row), step):
        k = slice(lo, lo + step)
        good[k] = (unit[row[k]] * index["unit"][at[k]]).sum(1) >= LEAST_COSINE
    good &= node[row] != index["node"][at]
    return row[good], at[good]


def named_roots(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links one[k]-two[k], and one that it is connected to, the same for all that are."""
    names, number = np.unique(np.concatenate([one, two]), return_inverse=True)
    half = len(number) // 2
    return names, names[joined_roots(len(names), number[:half], number[half:])] if half else names


def linked(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which vectors of `one` and `two` have a cosine of LEAST_COSINE or more in double precision."""
    sims = one.astype(np.float32) @ two.astype(np.float32).T
    out = sims >= LEAST_COSINE + SLACK
    a, b = np.nonzero(~out & (sims >= LEAST_COSINE - SLACK))
    for lo in range(0, len(a), 1 << 16):
        k = slice(lo, lo + (1 << 16))
        out[a[k], b[k]] = (one[a[k]] * two[b[k]]).sum(1) >= LEAST_COSINE
    return out


def blocks(m: Column) -> Column:
    """How many blocks `m` vectors (column `unit`) of a component are cut into."""
    most = F.greatest(F.floor(F.lit(BLOCK_BYTES) / F.octet_length("unit")), F.lit(1))
    return F.ceil(m / F.least(F.greatest(F.lit(BLOCK), BLOCK_GROWTH * F.sqrt(m)), most))


def exact_links(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """node and links (vectors of other nodes of its component): a row per pair of blocks that a node is in."""
    sizes = joined.groupBy("component").agg(F.count("*").alias("m"))
    rows = nodes.select("node", "copies", "unit").join(joined.join(sizes, "component"), "node")
    keys = ["component", "one", "two"]
    dealt = block_pairs(rows, blocks(F.col("m"))).select(*keys, "own", "node", "copies", "unit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(keys)):
            start = bounds(batch, len(keys))
            one, two, own = (batch.column(k).to_numpy() for k in ("one", "two", "own"))
            copies, raw = batch.column("copies").to_numpy(), batch.column("unit")
            links = np.zeros(len(batch), np.int64)
            for lo, hi in zip(start, start[1:]):
                unit = unit_rows(raw.slice(lo, hi - lo))
                for at in range(0, hi - lo, BLOCK):
                    near = linked(unit[at : at + BLOCK], unit)
                    near[np.arange(len(near)), at + np.arange(len(near))] = False
                    if one[lo] != two[lo]:
                        near &= own[lo + at : lo + at + len(near), None] != own[lo:hi]
                    links[lo + at : lo + at + len(near)] = near @ copies[lo:hi]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(links)], names=["node", "links"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(count, "node long, links long")


def cross_links(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node and links between wide and other nodes of a component (`members`: node, component, wide), for both ends."""
    sizes = members.groupBy("component").agg(F.count_if("wide").alias("n_wide"), F.count_if(~F.col("wide")).alias("n_other"))
    sizes = sizes.where("n_wide > 0 AND n_other > 0")
    rows = nodes.select("node", "copies", "unit").join(members.join(sizes, "component"), "node")
    mine, theirs = ("n_wide", "n_other"), ("n_other", "n_wide")
    own, other = (F.when(F.col("wide"), blocks(F.col(x))).otherwise(blocks(F.col(y))) for x, y in (mine, theirs))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), own))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    one, two = (F.when(F.col("wide"), x).otherwise(y) for x, y in ((F.col("own"), F.col("other")), (F.col("other"), F.col("own"))))
    keys = ["component", "one", "two"]
    dealt = rows.withColumn("one", one).withColumn("two", two).select(*keys, "wide", "node", "copies", "unit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(keys)):
            start, wide = bounds(batch, len(keys)), np.array(batch.column("wide").to_pylist(), bool)
            copies, raw = batch.column("copies").to_numpy(), batch.column("unit")
            links = np.zeros(len(batch), np.int64)
            for lo, hi in zip(start, start[1:]):
                unit = unit_rows(raw.slice(lo, hi - lo))
                own, others = np.flatnonzero(wide[lo:hi]), np.flatnonzero(~wide[lo:hi])
                for at in range(0, len(own), BLOCK):
                    few = own[at : at + BLOCK]
                    near = linked(unit[few], unit[others])
                    links[lo + few] = near @ copies[lo + others]
                    links[lo + others] += copies[lo + few] @ near
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(links)], names=["node", "links"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(count, "node long, links long")


def pair_links(nodes: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """node and links of the found pairs of nodes that are not wide, each pair once for both ends."""
    pairs = found.where(F.col("kind") == PAIR).select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct()
    narrow = nodes.select("node", "copies").join(members.where("NOT wide").select("node"), "node")
    for side in ("a", "b"):
        pairs = pairs.join(narrow.select(F.col("node").alias(side), F.col("copies").alias(f"{side}_copies")), side)
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(f"{y}_copies").alias("links")) for x, y in ("ab", "ba")))
    return pairs.select(F.inline(ends))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    small_bytes(vectors.sparkSession)
    rows = settled(vector_rows(vectors), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node", "unit").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = settled(nodes.withColumn("length", F.octet_length("unit").cast("long")), "vector-nodes")
    n, size = nodes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(SHARDS, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit("shard")), F.lit(shards)))
    indexes = settled(built(nodes, shards), "vector-graphs", FILE_PIECES)
    # Vectors go to every shard once, graphs to every part: more parts would move more bytes of graphs than of vectors.
    graphs = indexes.count() * PIECE_BYTES
    parts = max(1, min(-(-n // SEARCH_ROWS), -(-size * shards // max(1, graphs))))
    found = settled(searched(nodes, indexes, parts, shards), "vector-links")
    wide = found.where(F.col("kind") == WIDE).select("node", F.lit(True).alias("wide")).distinct()
    members = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(wide, "node", "left")
    members = settled(members.withColumn("wide", F.coalesce("wide", F.lit(False))), "vector-components")
    links = exact_links(nodes, members.where("wide").select("node", "component"))
    links = links.unionByName(cross_links(nodes, members)).unionByName(pair_links(nodes, found, members))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    of = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(members.drop("wide"), "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = of.join(least, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = rows.select("vec_id", "node")
    some = own.where("node IS NOT NULL").join(of, "node").select("vec_id", "n_links", "component_id")
    none = own.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
