"""Shards against their law, and the edits of the slot map."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from configsieve.llm import queries, sharding

SF_DIR = "/root/testdata/sf0.001"


def check_places(rows, docs):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["place"])
    for places in by_shard.values():
        assert sorted(places) == list(range(len(places)))
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sharding.shard_documents(docs, shards=8).collect()
    check_places(rows, docs.collect())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


def test_odd_documents(odd_documents, no_documents):
    check_places(sharding.shard_documents(odd_documents).collect(), odd_documents.collect())
    assert sharding.shard_documents(no_documents).count() == 0


def loads_of(seed, slots=500):
    rng = random.Random(seed)
    return {s: rng.randint(1, 1000) for s in range(slots) if rng.random() < 0.9}


def totals(slot_map, loads):
    out = Counter()
    for slot, shard in slot_map.items():
        out[shard] += loads.get(slot, 0)
    return out


def test_first_map_is_even():
    loads = loads_of(1)
    sizes = totals(sharding.first_map(loads, 10, 500), loads)
    assert max(sizes.values()) - min(sizes.values()) <= 50


def test_a_new_shard_takes_slots_only_into_itself():
    loads = loads_of(2)
    before = sharding.first_map(loads, 10, 500)
    after = sharding.rebalanced(before, loads, 11)
    moved = {s for s in before if before[s] != after[s]}
    assert moved
    assert {after[s] for s in moved} == {10}
    assert totals(after, loads)[10] > 0.9 * sum(loads.values()) / 11


def test_a_removed_shard_is_emptied():
    loads = loads_of(3)
    after = sharding.rebalanced(sharding.first_map(loads, 10, 500), loads, 9)
    assert set(after.values()) == set(range(9))


def test_even_shards_stay():
    loads = dict.fromkeys(range(100), 5)
    before = sharding.first_map(loads, 10, 100)
    assert sharding.rebalanced(before, loads, 10) == before


def test_map_versions(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.write_map(spark, path, {0: 3, 1: 2}, 0)
    sharding.write_map(spark, path, {0: 3, 1: 4}, 1)
    read = [{r.virtual_slot: r.shard for r in sharding.read_map(spark, path, v).collect()} for v in (0, 1)]
    assert read == [{0: 3, 1: 2}, {0: 3, 1: 4}]


def spark_hash(*values):
    """What xxhash64 of these columns is: longs, and ints as (int,); a null leaves the seed as it is."""
    seed = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def naive_shards(docs, shards, slots, place_rows, slot_map=None):
    """(doc_id, size, crc, slot, shard, place) of each document, by hand; the largest slots go first, to the emptiest shard."""
    rows = []
    for d in docs:
        raw = (d.text or "").encode()
        crc = zlib.crc32(raw)
        rows.append((d.doc_id, len(raw) + 16, crc, spark_hash(d.doc_id, crc) % slots))
    load = Counter()
    for _, size, _, slot in rows:
        load[slot] += size
    if slot_map is None:
        slot_map, full = {}, [0] * shards
        for slot in sorted(range(slots), key=lambda s: (-load[s], s)):
            slot_map[slot] = k = min(range(shards), key=lambda s: (full[s], s))
            full[k] += max(load[slot], 1)
    n_buckets = {slot: -(-n // place_rows) for slot, n in Counter(r[3] for r in rows).items()}

    def order(r):
        doc_id, _, crc, slot = r
        return slot, spark_hash(crc, doc_id, (7,)) % n_buckets[slot], doc_id is not None, doc_id or 0, crc

    out, place = [], Counter()
    for r in sorted(rows, key=order):
        shard = slot_map[r[3]]
        out.append((*r, shard, place[shard]))
        place[shard] += 1
    return out


COLUMNS = ("doc_id", "size", "text_crc32", "virtual_slot", "shard", "place")


@pytest.mark.parametrize("place_rows", [20_000, 3])
def test_map_and_places_by_hand(spark, monkeypatch, odd_documents, place_rows):
    monkeypatch.setattr(sharding, "PLACE_ROWS", place_rows)
    for docs, slots in ((spark.read.parquet(f"{SF_DIR}/documents.parquet"), 32), (odd_documents, 8)):
        rows = sharding.shard_documents(docs, shards=5, slots=slots).select(*COLUMNS).collect()
        assert Counter(map(tuple, rows)) == Counter(naive_shards(docs.collect(), 5, slots, place_rows))


def test_the_registered_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = queries.op5_sharding(spark, SF_DIR).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    found = Counter((r.doc_id, r["size"], r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in rows)
    assert found == Counter(naive_shards(docs, 40, sharding.SLOTS, sharding.PLACE_ROWS))


def test_resharding_from_version_to_version(spark, tmp_path):
    """The table grows, a shard comes, two go: each time the newest map is edited, stored and applied."""
    path = f"file://{tmp_path}/map"
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    some = docs.where("doc_id % 2 = 0")
    sharding.shard_documents(some, shards=6, slots=256, map_path=path).count()
    first = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 0).collect()}
    old = first
    for step, shards in enumerate([6, 7, 5, 5], 1):
        rows = sharding.reshard_documents(docs, path, shards).collect()
        assert sharding.newest_version(spark, path) == step
        new = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, step).collect()}
        naive = naive_shards(docs.collect(), shards, 256, sharding.PLACE_ROWS, new)
        assert Counter(tuple(r[c] for c in COLUMNS) for r in rows) == Counter(naive)
        assert all((r.previous_shard, r.shard) == (old[r.virtual_slot], new[r.virtual_slot]) for r in rows)
        assert {r.shard for r in rows} == set(range(shards))
        moved = {(r.previous_shard, r.shard) for r in rows if r.previous_shard != r.shard}
        load = Counter()
        for r in rows:
            load[r.virtual_slot] += r["size"]
        sizes = totals(new, load)
        if step == 2:
            assert moved and {to for _, to in moved} == {6}
        elif step == 4:  # nothing has changed since
            assert not moved and old == new
        else:  # no slot can move from the fullest shard to the emptiest and narrow the gap
            gap = max(sizes.values()) - min(sizes.values())
            full = max(sizes, key=lambda s: (sizes[s], -s))
            assert moved and all(load[s] >= gap for s, k in new.items() if k == full and load[s])
        old = new
    # Earlier versions stay as they were.
    assert {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 0).collect()} == first


def test_resharding_an_empty_table(spark, tmp_path, no_documents):
    path = f"file://{tmp_path}/map"
    assert sharding.shard_documents(no_documents, shards=3, slots=16, map_path=path).count() == 0
    assert sharding.reshard_documents(no_documents, path, 2).count() == 0
    assert {r.shard for r in sharding.read_map(spark, path, 1).collect()} == {0, 1}
