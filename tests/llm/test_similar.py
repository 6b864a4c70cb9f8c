from __future__ import annotations

import os
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pytest

import corpus_pipeline
from skyloom.llm import simhash
from skyloom.llm.simhash import keep_one_of_similar, similar_components

from .helpers import documents, frame, prose


def plain_set(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(docs: list[tuple]) -> list[int]:
    sets = [plain_set(r[1]) for r in docs]
    label, changed = list(range(len(docs))), True
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            least = min(label[i], label[j])
            changed = changed or label[i] != label[j]
            label[i] = label[j] = least
    return label


def corpus() -> list[tuple]:
    """Copies with one word in so many changed (above and below 0.8), chains of them, and a passage that many texts hold."""
    rng = random.Random(9)
    docs = documents(4)
    for k in range(12):
        words = prose(rng, 150).split()
        for step in range(5):
            docs.append((1000 + 10 * k + step, " ".join(words), "en", "web", None))
            for at in rng.sample(range(150), 1 + (k + step) % 6):
                words[at] = f"new{rng.randrange(10**6)}"
    passage = prose(rng, 40)
    docs += [(2000 + k, f"{prose(rng, 5 + k % 9)} {passage}", "en", "web", None) for k in range(60)]
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_every_near_copy_goes(spark, monkeypatch, small):
    """small: groups, parts and broadcasts of few rows, so that every way for more is taken."""
    if small:
        for name, n in (("GROUP", 8), ("TILE", 4), ("VERIFIED_SETS", 5), ("BROADCAST_IDS", 3)):
            monkeypatch.setattr(simhash, name, n)
    docs = corpus()
    label = plain_components(docs)
    names = set()
    for own in set(label):
        ids = [r[0] for r, x in zip(docs, label, strict=True) if x == own and r[0] is not None]
        names |= {min(ids)} if ids else set()
    df = frame(spark, docs, extra=True)
    kept = keep_one_of_similar(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(names)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["nameless text of its own here"]


def test_the_stage_drops_near_copies_far_apart_in_bits(spark):
    """Similarity over 0.8, but more than 4 bits between the fingerprints."""
    from skyloom.llm.simhash import fingerprint

    rng = random.Random(3)
    while True:
        words = prose(rng, 120).split()
        other = [*words]
        other[40], other[80] = "changed", "again"
        a, b = " ".join(words), " ".join(other)
        if (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 4:
            break
    df = frame(spark, [(1, a, "en", "s", None), (2, b, "en", "s", None), (3, prose(rng, 100), "en", "s", None)])
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()) == [1, 3]


def test_empty_table(spark):
    assert keep_one_of_similar(frame(spark, [])).collect() == []


def test_repeated_ids_and_rows(spark):
    rng = random.Random(1)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, b, "en", "s", None), (5, a, "en", "s", None), (5, a, "en", "s", None), (6, a, "en", "s", None), (7, c, "en", "s", None), (None, c, "en", "s", None)]
    kept = sorted((r.doc_id, r.text) for r in keep_one_of_similar(frame(spark, rows)).collect())
    assert kept == [(5, min(a, b)), (7, c)]


def test_against_all_pairs_of_the_test_table(spark):
    """Every two texts with a similarity of 0.8 are joined, and no others."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sets = [plain_set(t) for _, t in docs]
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    label = list(range(len(docs)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    empty = [k for k, s in enumerate(sets) if not s]
    pairs = {(i, j) for own in by.values() for i in own for j in own if i < j} | set(zip(empty, empty[1:], strict=False))
    for i, j in pairs:
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            i, j = top(i), top(j)
            label[max(i, j)] = min(i, j)
    named = {}
    for k, (doc_id, _) in enumerate(docs):
        named.setdefault(top(k), []).append(doc_id)
    expected = {d: min(own) for own in named.values() for d in own}
    assert {r.doc_id: r.component_id for r in similar_components(df).collect()} == expected
