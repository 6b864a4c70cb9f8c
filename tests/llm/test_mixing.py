from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from skyloom.llm.mixing import EPOCHS, SEED, WEIGHTS, mix, mix_copies

from .helpers import documents, frame


def fill(children: dict, weights: dict, budget: int) -> dict:
    """Shares of a budget by weight, what a full child can't hold shared by the others; then whole tokens."""
    open_, left, level = dict(children), budget, 0.0
    done = {}
    while open_:
        level = left / sum(weights.get(k, 1) for k in open_)
        full = [k for k, cap in open_.items() if cap / weights.get(k, 1) <= level]
        if not full:
            break
        for k in full:
            done[k] = open_.pop(k)
            left -= done[k]
    return done | {k: min(cap, int(level * weights.get(k, 1))) for k, cap in open_.items()}


def plain(docs, budget=None, epochs=EPOCHS):
    rows = []
    for doc_id, text, lang, source, _ in docs:
        domain = f"domain{int(source[3:]) % 4}" if source and re.fullmatch(r"src[0-9]+", source) else "other"
        rows.append((doc_id, (domain, lang or "unknown", source or "unknown"), len(re.findall(r"[^ \t-\r]+", text or ""))))
    tokens = defaultdict(int)
    for _, leaf, n in rows:
        for depth in range(4):
            tokens[leaf[:depth]] += n
    shares = {(): min(tokens[()] * epochs, tokens[()] if budget is None else budget)}
    for depth, level in enumerate(("domain", "leaf_lang", "leaf_source")):
        for parent in [p for p in shares if len(p) == depth]:
            children = {k[depth]: n * epochs for k, n in tokens.items() if len(k) == depth + 1 and k[:depth] == parent}
            shares |= {(*parent, k): v for k, v in fill(children, WEIGHTS[level], shares[parent]).items()}
    copies = []
    for leaf in {r[1] for r in rows}:
        own, total, share = [r for r in rows if r[1] == leaf], tokens[leaf], shares[leaf]
        full, rest = (share // total, share % total) if total else (0, 0)
        draw = lambda r: (hashlib.md5(f"{SEED}:{full}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0)  # noqa: B023, E731
        by_draw = defaultdict(int)
        for r in own:
            by_draw[draw(r)] += r[2]
        through, taken = 0, set()
        for key in sorted(by_draw):
            through += by_draw[key]
            if rest and through <= rest:
                taken.add(key)
        copies += [(r[0], *leaf, r[2], full + (draw(r) in taken)) for r in own]
    return sorted(copies, key=repr)


@pytest.mark.parametrize("budget", [None, 100, 3000, 10**9])
def test_copies(spark, budget):
    docs = documents()
    found = mix_copies(frame(spark, docs, extra=True), budget=budget)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(docs, budget)


def test_rows_repeat_by_their_copies(spark):
    docs = documents()
    df = frame(spark, docs, extra=True)
    out = mix(df)
    assert out.columns == df.columns
    expected = sorted(r[0] for r in plain(docs) for _ in range(r[5]) if r[0] is not None)
    assert sorted(r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None) == expected


def test_empty_and_tokenless(spark):
    assert mix_copies(frame(spark, [])).collect() == [] and mix(frame(spark, [])).collect() == []
    assert [r.copies for r in mix_copies(frame(spark, [(1, None, None, None, None), (2, " ", "en", "src1", 1)])).collect()] == [0, 0]


def test_weights_are_positive(spark):
    with pytest.raises(ValueError):
        mix_copies(frame(spark, documents()), weights={"domain": {"domain0": 0}})


def test_sources_of_any_number(spark):
    """The domain of a number beyond all integers, as of a short one."""
    rows = [(k, "one two three", "en", f"src{n}", None) for k, n in enumerate(["7", "99999999999", "1" * 40, "0", "", "x1", "00000000000000000000012"])]
    found = {r.doc_id: r.domain for r in mix_copies(frame(spark, rows)).collect()}
    assert [found[k] for k in range(7)] == ["domain3", "domain3", "domain3", "domain0", "other", "other", "domain0"]


def test_oracle_on_long_numbers():
    import duckdb

    from skyloom.llm.mixing import oracle

    con = duckdb.connect()
    con.sql("create table documents as select * from (values (1, 'a b', 'en', 'src99999999999'), (2, 'c', 'en', 'src7')) t(doc_id, text, lang, source)")
    assert {r[1] for r in con.sql(f"select doc_id, domain from ({oracle()})").fetchall()} == {"domain3"}
