from __future__ import annotations

import random
import zlib

import pytest

from skyloom.llm import sharding
from skyloom.llm.sharding import assign_shards, write_shards

from .helpers import documents, frame, prose


def check(rows, docs, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs), key=repr)
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(r.size for r in rows)
    assert all(abs(s - sum(sizes) / shards) <= largest for s in sizes)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(spark, shards):
    docs = documents()
    check(assign_shards(frame(spark, docs, extra=True), shards).collect(), docs, shards)


def test_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 8)
    rng = random.Random(0)
    docs = [(k, "the same text again", "en", "s", None) for k in range(700)] + [(1000 + k, prose(rng, 20), "en", "s", None) for k in range(600)]
    rows = assign_shards(frame(spark, docs), 6).collect()
    check(rows, docs, 6)
    twice = [(k % 50, f"text {k % 50}", "en", "s", None) for k in range(400)]
    rows = assign_shards(frame(spark, twice), 4).collect()
    check(rows, twice, 4)
    shards = {}
    for r in rows:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 3  # only texts at a boundary


def test_written_shards(spark, tmp_path):
    docs = [r for r in documents() if r[0] != 44]
    write_shards(frame(spark, docs), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(docs) and {r.shard_no for r in back.select("shard_no").distinct().collect()} == {0, 1, 2, 3}


def test_empty_table(spark):
    assert assign_shards(frame(spark, [])).collect() == []
