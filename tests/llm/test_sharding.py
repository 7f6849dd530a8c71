import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from undula.llm import sharding
from undula.llm.sharding import SLOTS, SlotMap, shard, slot_bytes


def test_law_and_places(corpus, rng):
    rows = [(i, rng.choice(ODD)) for i in range(3000)] + [(None, "x"), (7, "again"), (7, "again")]
    got = shard(corpus(rows, parts=4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and (r.grown_shard == r.shard or r.grown_shard == 24)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.5 * len(rows) / 25 < moved < 2 * len(rows) / 25
    # the key and the number of shards decide, whatever else is there
    alone = {r.doc_id: r.shard for r in shard(corpus([r for r in rows if r[0] and r[0] % 5 == 0], name="b")).collect()}
    assert all({r.doc_id: r.shard for r in got}[k] == v for k, v in alone.items())


def test_hot_keys_and_clashing_columns(spark, corpus, monkeypatch):
    """A repeated row, a repeated id and null ids; columns named like inner ones."""
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = [(None, f"t{i}") for i in range(500)] + [(5, "same")] * 1050 + [(6, f"t{i}") for i in range(300)]
    docs = corpus(rows).withColumns({c: F.lit("x") for c in ("n", "part", "size", "virtual_slot", "first", "shard", "run", "again", "bytes")})
    got = shard(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got if r.doc_id == 5) == [(False, 5, 12)] * 1050 and len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.virtual_slot_bytes for r in got if r.doc_id == 5} == {1050 * 12}


def test_the_stored_map_decides(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/map"
    got = shard(corpus([(i, "x") for i in range(200)]), path=path).collect()
    now, grown = SlotMap.read(spark, path, 1), SlotMap.read(spark, path, 2)
    assert now == SlotMap.initial(24) and grown == now.grow()
    assert all(r.shard == now.shards[r.virtual_slot] and r.grown_shard == grown.shards[r.virtual_slot] for r in got)
    edited = grown.rebalance({slot: 5 for slot in range(100)})
    edited.store(spark, path)
    assert SlotMap.read(spark, path, 3) == edited and SlotMap.read(spark, path, 1) == now


def test_map_versions():
    first = SlotMap.initial(24)
    grown = first.grow()
    assert grown.version == 2 and grown.n_shards == 25
    assert all(b in (a, 24) for a, b in zip(first.shards, grown.shards, strict=True))
    held = [grown.shards.count(s) for s in range(25)]
    assert max(held) - min(held) <= 24 and held[24] == SLOTS // 25
    heavy = {slot: 1000 if s == 3 else 10 for slot, s in enumerate(first.shards)}
    even = first.rebalance(heavy)
    load = [0] * 24
    for slot, s in enumerate(even.shards):
        load[s] += heavy[slot]
    assert max(load) <= sum(load) / 24 + 2 * 1000 and even.version == 2  # slots move whole
    with pytest.raises(ValueError, match="between"):
        SlotMap.initial(0)


def test_totals_and_empty_tables(spark, corpus):
    docs = corpus([(i, "abc") for i in range(100)] + [(None, None)])
    assert slot_bytes(docs).groupBy().sum("rows", "bytes").first()[:] == (101, 100 * 11 + 8)
    assert SlotMap.initial(4, 8).table(spark).count() == 8
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
