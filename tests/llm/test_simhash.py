from __future__ import annotations

import random
import re

import numpy as np
import pytest

from skyloom.llm import simhash
from skyloom.llm.simhash import components, fingerprint, fingerprint_links, near_duplicates, part_masks, parts_for

from .helpers import documents, frame, prose

xxhash = pytest.importorskip("xxhash")


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], radius: int) -> list[int]:
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if (values[i] ^ values[j]).bit_count() <= radius and label[i] > label[j]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints():
    rng = random.Random(2)
    for text in [None, "", " \t", "one", "one two three", "A b C d", "É x\x85y z w v", prose(rng, 5000)] + [prose(rng, rng.randint(1, 60)) for _ in range(40)]:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize(("m", "radius"), [(5, 4), (6, 4), (8, 4), (4, 3)])
def test_every_near_pair_shares_a_part(m, radius):
    rng = random.Random(m)
    masks = part_masks(m, radius)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(a & k == b & k for k in masks)
    assert parts_for(10, 4) == 5 and parts_for(10**9, 4) > 5


@pytest.mark.parametrize(("group", "tile"), [(2048, 256), (16, 256), (2048, 8), (16, 3)])
def test_components_of_links(spark, monkeypatch, group, tile):
    """Chains, dense groups (more than a tile, more than a group) and lone fingerprints."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(8):
        at = rng.choice(values)
        for _ in range(rng.randint(1, 12)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << bit
            values.append(at)
    centre = rng.getrandbits(64)
    values += [centre ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20, 40)) for _ in range(120)]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r.node: r.root for r in components(links).collect()}
    expected = plain_components(values, 4)
    groups = {}
    for x, label in zip(signed, expected, strict=True):
        groups.setdefault(label, []).append(x)
    for own in groups.values():
        assert {root.get(x, x) for x in own} == {min(own)}


def test_documents(spark):
    docs = documents()
    found = sorted((tuple(r) for r in near_duplicates(frame(spark, docs, extra=True)).collect()), key=repr)
    values = [plain_fingerprint(r[1]) for r in docs]
    label = plain_components(values, 4)
    expected = []
    for r, value, own in zip(docs, values, label, strict=True):
        ids = [o[0] for o, k in zip(docs, label, strict=True) if k == own and o[0] is not None]
        expected.append((r[0], f"{value:016x}", min(ids) if ids else None))
    assert found == sorted(expected, key=repr)


def test_tiles_find_every_link_and_skip_far_counts(monkeypatch):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 64, 600, np.uint64) & rng.integers(0, 1 << 64, 600, np.uint64)
    fps[::3] = fps[1::3] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps[:50] = 0xFFFFFFFFFFFFFFFF
    group = rng.integers(0, 4, 600)
    order = np.lexsort((np.bitwise_count(fps), group))
    group, fps = group[order], fps[order]
    every = {(i, j) for i in range(600) for j in range(i + 1, 600) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    monkeypatch.setattr(simhash, "TILE", 16)
    met, count = [], np.bitwise_count

    def counted(x):
        met.append(x.ndim)
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    i, j = simhash.tile_links(group, fps, 4)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == every and every
    pairs = sum(n == 2 for n in met)
    assert 38 <= pairs < 38 * 39 // 2 // 4  # of all tile pairs


def test_groups_are_never_cut():
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted(rng.randrange(30) for _ in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(200), pa.int64())], ["group", "x"])
    for width in (1, 7, 64, 500):
        out = list(simhash.whole_groups(batch.slice(k, width) for k in range(0, 200, width)))
        assert [x for b in out for x in b.column(1).to_pylist()] == list(range(200))
        seen = [set(b.column(0).to_pylist()) for b in out]
        assert sum(map(len, seen)) == len(set(keys))


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
