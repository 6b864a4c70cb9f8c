from __future__ import annotations

import random
import re

import pytest

from skyloom.llm import decontaminate as d
from skyloom.llm.decontaminate import contained_items

from .helpers import documents, frame, prose


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w: list[str], k: int) -> set:
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(docs, items, threshold=0.8):
    found = {}
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        own = shingles(w, min(5, len(w)))
        need = max(1, -(-round(threshold * 1000) * len(own) // 1000))
        for r in docs:
            shared = len(own & shingles(words(r[1]), min(5, len(w))))
            if shared >= need and shared > found.get((r[0], item_id), (0, 0, 0))[1]:
                found[r[0], item_id] = (len(own), shared, shared / len(own))
    return sorted(((*k, *v) for k, v in found.items()), key=repr)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contained_items(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_ROWS", limit)
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(1, 60))) for k in range(12)] + [(20, None), (21, ""), (22, "two words"), (22, "two words"), (None, "an item without an id at all")]
    docs = documents()
    for k, (item_id, text) in enumerate(items[:12]):
        w = text.split()
        changed = w[: len(w) // 2] + ["zz"] + w[len(w) // 2 + 1 :]
        docs.append((100 + k, prose(rng, 300) + "\n" + text.upper() + " " + prose(rng, 200), "en", "src1", None))
        docs.append((200 + k, " ".join(changed), "en", "src1", None))
    docs += [(300, "So Two, words! Here", "en", "s", None), (301, "say an item without an id at all now", "en", "s", None)]
    found = contained_items(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(docs, items)


def test_leaking_documents_go(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    docs = [(1, "clean words only", "en", "s", None), (2, f"x {item} y", "en", "s", None), (None, "nameless and clean", "en", "s", None), (3, None, "en", "s", None)]
    kept = d.decontaminate(frame(spark, docs), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(frame(spark, []), items).collect() == []
    assert contained_items(frame(spark, documents()), items.limit(0)).collect() == []
    assert d.decontaminate(frame(spark, documents()), items.limit(0)).count() == len(documents())


def test_sql_sees_short_items(spark):
    """Items of one to seven words, by the query's SQL and by the operator."""
    import random

    import duckdb

    from skyloom.llm.decontaminate import ORACLE

    from .helpers import prose

    rng = random.Random(4)
    items = [(k, prose(rng, k)) for k in range(1, 8)] + [(9, ""), (10, None), (11, "...")]
    docs = [(k, f"{prose(rng, 12)} {items[k % 7][1]} {prose(rng, 9)}", "en", "s", None) for k in range(40)] + [(99, None, "en", "s", None), (98, items[1][1], "en", "s", None)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in docs])
    con.executemany("insert into benchmark values (?, ?)", items)
    expected = sorted(con.sql(ORACLE).fetchall())
    found = contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "item_id", "item_shingles", "shared", "containment").collect()) == expected
    assert {r[1] for r in expected} == {1, 2, 3, 4, 5, 6, 7}
