"""Vector links against all pairs in double precision."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from configsieve.llm import near_vectors, small_world
from configsieve.llm.small_world import SmallWorld

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    good = {}
    for k, (_, v) in enumerate(rows):
        v = np.array([np.nan if x is None else x for x in v or ()], float)
        if len(v) and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            good[k] = v / np.linalg.norm(v)
    near = {k: {j for j, w in good.items() if j != k and len(w) == len(good[k]) and good[k] @ w >= 0.9} if k in good else set()
            for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        group, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        least = min(rows[g][0] for g in group)
        out.append((rows[k][0], len(near[k]), least, rows[k][0] == least))
    return Counter(out)


def found(frame):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert found(near_vectors.near_duplicates(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"))) == brute(rows)


@pytest.mark.parametrize("shard_rows", [65_536, 100])
def test_groups_of_copies_and_odd_vectors(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(near_vectors, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(8)
    vectors = list(rng.normal(size=(400, 16)))
    for n, spread in ((300, 0.05), (60, 0.12), (9, 0.2)):
        vectors += list(rng.normal(size=16) + spread * rng.normal(size=(n, 16)))
    vectors += [vectors[410]] * 40 + [vectors[5] * 1e200, vectors[6] * 1e-200]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [3.0]]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [rows[3]]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, shard int")
    assert found(near_vectors.near_duplicates(frame)) == brute(rows)
    assert near_vectors.near_duplicates(frame.where("false")).count() == 0


def test_vectors_without_id(spark):
    """They link and count like others; a component is named by the least id that there is, if any."""
    one, near, two, alone = ([1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    rows = [(None, one), (7, near), (4, one), (None, two), (None, two), (None, None), (9, alone)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(near_vectors.near_duplicates(frame)) == Counter([
        (None, 2, 4, False), (7, 2, 4, False), (4, 2, 4, True),
        (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True),
    ])


def test_graph_finds_neighbours_and_full_beams_widen():
    rng = np.random.default_rng(2)
    unit = np.vstack([rng.normal(size=(1500, 24)), rng.normal(size=24) + 0.03 * rng.normal(size=(500, 24))])
    unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)
    unit = unit[rng.permutation(len(unit))]
    graph = SmallWorld(unit)
    row, at = graph.within(unit, 0.9, 16)
    assert len(set(zip(row.tolist(), at.tolist()))) == len(row)
    true = int((unit @ unit.T >= 0.9).sum())
    assert len(row) >= 0.999 * true
    assert near_vectors.audited_beam(graph) <= len(unit)


class Blind(SmallWorld):
    """Finds all links with a beam of 64, and with less only (nearly) equal vectors."""

    def within(self, q, least, beam):
        return np.nonzero(q @ self.unit.T >= (least if beam >= 64 else 0.9999))


@pytest.mark.parametrize("pairs", [0, 25, 500])
def test_audit_does_not_count_a_vector_as_its_own_link(pairs):
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(1000, 32))
    unit[1000 - pairs :] = unit[:pairs] + 0.2 * rng.normal(size=(pairs, 32))
    unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)
    assert near_vectors.audited_beam(Blind(unit)) >= 64


def test_audit_is_not_decided_by_one_group():
    """All links of the group are found, none of the pairs beside it."""
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(1000, 32))
    unit[:300] = unit[0] + 0.05 * rng.normal(size=(300, 32))
    unit[900:] = unit[800:900] + 0.2 * rng.normal(size=(100, 32))
    unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)

    class Partly(SmallWorld):
        def within(self, q, least, beam):
            sims = q @ self.unit.T
            hit = sims >= least
            lone = hit.sum(1) < 100
            hit[lone] &= (beam >= 64) | (sims[lone] >= 0.9999)
            return np.nonzero(hit)

    assert near_vectors.audited_beam(Partly(unit)) >= 64


def test_links_found_from_one_side_count_for_both(spark, monkeypatch):
    """Every pair is found from one of its vectors only."""
    whole = SmallWorld.within

    def one_sided(self, q, least, beam):
        row, at = whole(self, q, least, beam)
        good = q[row, 0] > self.unit[at, 0]
        return row[good], at[good]

    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(120, 16))
    vectors[60:] = vectors[:60] + 0.1 * rng.normal(size=(60, 16))
    vectors[100:] = vectors[0] + 0.1 * rng.normal(size=(20, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(200, [float(x) for x in vectors[3]])]
    nodes = near_vectors.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("node IS NOT NULL")
    nodes = nodes.groupBy("node", "unit").agg(near_vectors.F.count("*").alias("copies")).toPandas()
    unit = np.stack([np.frombuffer(u) for u in nodes["unit"]])
    monkeypatch.setattr(SmallWorld, "within", one_sided)
    index = {"unit": unit, "node": nodes["node"].to_numpy(), "copies": nodes["copies"].to_numpy(), "beam": 16}
    found = near_vectors.found_links(SmallWorld(unit), index, index["node"], unit)
    found = spark.createDataFrame(found.to_pandas())
    monkeypatch.undo()
    joined = near_vectors.components(found.selectExpr("node AS a", "root AS b"))
    frame = spark.createDataFrame([(int(n), int(c), u) for n, c, u in zip(nodes["node"], nodes["copies"], nodes["unit"])], "node long, copies long, unit binary")
    links = near_vectors.exact_links(frame, joined).groupBy("node").agg(near_vectors.F.sum("links").alias("links"))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = dict(zip(index["node"].tolist(), (near @ index["copies"]).tolist()))
    assert {r.node: r.links for r in links.collect()} == {n: w for n, w in want.items() if w}


@pytest.mark.parametrize("block", [256, 7])
def test_wide_vectors_and_those_at_their_edge(spark, monkeypatch, block):
    """Clouds in which some vectors have a full beam of links and others few, chains of vectors, and copies of both."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "BLOCK_GROWTH", 1)
    rng = np.random.default_rng(21)
    vectors = list(rng.normal(size=(150, 12)))
    for n in (150, 90):
        center, spread = rng.normal(size=12), rng.uniform(0.05, 0.6, (n, 1))
        vectors += list(center + spread * rng.normal(size=(n, 12)))
    angle = np.arange(60) * 0.3
    vectors += [np.concatenate([[np.cos(a / 6), np.sin(a / 6)], np.zeros(10)]) for a in angle]
    vectors += [vectors[160]] * 5 + [vectors[-1]] * 3
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    want = brute(rows)
    links = [n for _, n, _, _ in want]
    assert any(0 < n < 16 for n in links) and any(n > 40 for n in links)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(near_vectors.near_duplicates(frame)) == want


def test_long_vectors_make_more_shards(spark, monkeypatch):
    """No graph holds more bytes than about SHARD_BYTES, and blocks are bounded by bytes too."""
    monkeypatch.setattr(near_vectors, "SHARD_BYTES", 40 * 512 * 8)
    monkeypatch.setattr(near_vectors, "BLOCK_BYTES", 10 * 512 * 8)
    used = []
    whole = near_vectors.built
    monkeypatch.setattr(near_vectors, "built", lambda nodes, shards: used.append(shards) or whole(nodes, shards))
    rng = np.random.default_rng(22)
    vectors = rng.normal(size=(500, 512))
    vectors[400:] = vectors[0] + 0.1 * rng.normal(size=(100, 512))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(near_vectors.near_duplicates(frame)) == brute(rows)
    assert used == [13]


def unit_vectors(n, width, seed):
    unit = np.random.default_rng(seed).normal(size=(n, width))
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def test_no_row_holds_a_graph(spark):
    """A row with a graph is held once per task that searches it; its pieces give back the same graph."""
    unit = unit_vectors(3000, 64, 31)
    rows = [(512, 0, k, 1, u.tobytes()) for k, u in enumerate(unit)]
    nodes = spark.createDataFrame(rows, "length long, shard long, node long, copies long, unit binary")
    made = near_vectors.built(nodes, 1).collect()
    assert max(len(r["index"]) for r in made) <= 64 << 10
    whole = near_vectors.Pieces()
    for r in sorted(made, key=lambda r: r["piece"]):
        whole.add(bytes(r["index"]))
    index, graph = whole.index(), SmallWorld(unit)
    assert (index["unit"] == unit).all() and index["node"].tolist() == list(range(3000)) and index["copies"].sum() == 3000
    layers = SmallWorld.whole_layers(index["layers"], index["order"])
    assert len(layers) == len(graph.layers) > 1 and all((a == b).all() for a, b in zip(layers, graph.layers))
    assert (index["order"] == graph.order).all() and len(index["layers"][-1]) == 3000 > len(index["layers"][0])


def test_one_vector_makes_a_graph_in_pieces(monkeypatch):
    monkeypatch.setattr(near_vectors, "PIECE_BYTES", 10)
    for unit in (unit_vectors(1, 3, 32), unit_vectors(2, 5, 33)):
        graph, whole = SmallWorld(unit), near_vectors.Pieces()
        index = {"unit": unit, "node": np.arange(len(unit)), "layers": graph.members_only(), "order": graph.order, "none": np.zeros(0), "beam": 1}
        for piece in near_vectors.in_pieces(index):
            whole.add(piece)
        found = whole.index()
        assert (found["unit"] == unit).all() and found["node"].tolist() == list(range(len(unit))) and not len(found["none"])
        for a, b in zip(SmallWorld.whole_layers(found["layers"], found["order"]), graph.layers, strict=True):
            assert (a == b).all()


def test_pieces_come_in_several_files_and_batches(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "FILE_PIECES", 2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    vectors = list(unit_vectors(700, 160, 34))
    vectors += [vectors[k % 9] + 0.02 * v for k, v in enumerate(unit_vectors(90, 160, 35))]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set(key, "4")
    try:
        assert found(near_vectors.near_duplicates(frame)) == brute(rows)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_graphs_are_no_more_bytes_than_vectors_sent(spark, monkeypatch):
    """Each part of a shard's search gets the whole graph, so many parts of few vectors would mostly move graphs."""
    monkeypatch.setattr(near_vectors, "SEARCH_ROWS", 1)
    used, whole = [], near_vectors.searched
    monkeypatch.setattr(near_vectors, "searched", lambda nodes, indexes, parts, shards: used.append(parts) or whole(nodes, indexes, parts, shards))
    vectors = list(unit_vectors(60, 16, 36))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors + vectors[:5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(near_vectors.near_duplicates(frame)) == brute(rows)
    assert used == [1]


def test_long_vectors_are_not_gathered_all_at_once():
    unit = unit_vectors(500, 4096, 37).astype(np.float32)
    tracemalloc.start()
    graph = SmallWorld(unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * unit.nbytes
    assert len(graph.within(unit, 0.9, 16)[0]) == 500


def test_widened_beams_go_a_few_at_a_time(monkeypatch):
    unit = unit_vectors(1, 24, 38) + 0.02 * unit_vectors(250, 24, 39)
    unit = np.vstack([unit, unit_vectors(150, 24, 40)])
    unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)
    graph, most, whole = SmallWorld(unit), [], SmallWorld._beam
    want = set(zip(*(x.tolist() for x in graph.within(unit, 0.9, 16))))

    def watched(self, q, entry, beam, links):
        most.append(len(q) * beam)
        return whole(self, q, entry, beam, links)

    monkeypatch.setattr(SmallWorld, "_beam", watched)
    monkeypatch.setattr(small_world, "PLACES", 3000)
    row, at = graph.within(unit, 0.9, 16)
    assert set(zip(row.tolist(), at.tolist())) == want and len(row) == len(want) >= 250 * 250
    assert max(most) <= 3000
