from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import brown_lm
from skyloom.llm.brown_lm import exchange, score_texts, train_model, words_of

from .helpers import documents, frame, prose


def test_exchange_finds_what_alternates():
    """Words of two kinds that follow each other end in two classes."""
    rng = np.random.default_rng(0)
    n = 21
    follow = np.zeros((n, n), np.int64)
    for a in range(20):
        for b in range(20):
            if (a + b) % 2:
                follow[a, b] = rng.integers(5, 30)
    of = exchange(follow, classes=2, sweeps=10)
    assert of[20] == 2 and len({(of[k], k % 2) for k in range(20)}) == 2


def test_each_move_gains():
    rng = np.random.default_rng(1)
    follow = rng.poisson(0.6, (31, 31))

    def likelihood(of):
        member = np.zeros((31, 5))
        member[np.arange(31), of] = 1
        joint = member.T @ follow @ member
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(joint) - f(joint.sum(0)) - f(joint.sum(1))

    values = [likelihood(exchange(follow, classes=4, sweeps=k)) for k in (0, 1, 2, 6)]
    assert values == sorted(values) and values[0] < values[-1]


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("frequent", [65_534, 5])
def test_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    monkeypatch.setattr(brown_lm, "COUNTED_AT_ONCE", 20)
    docs = [*documents(), (90, prose(random.Random(1), 30_000), "en", "s", None)]
    counts: Counter = Counter()
    for r in docs:
        if not held_out(r[0]):
            counts.update([*words_of((r[1] or "").encode()), b""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in docs:
        tokens = [*words_of((r[1] or "").encode()), b""]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        expected.append((r[0], held_out(r[0]), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(float(base), 6)))
    found = score_texts(frame(spark, docs, extra=True)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.score < 0 for r in found)


def plain_tables(model):
    """Place, count and class of every word of training."""
    table = {w: (int(model.counts[i]), int(model.classes[i])) for w, i in model.words.items()}
    return table | {bytes(r.word): (r.n, r["class"]) for r in model.rare.collect()}


@pytest.mark.parametrize("frequent", [65_534, 40, 0])
def test_scores_are_those_of_the_model(spark, monkeypatch, frequent):
    """Against a plain walk over each text; the model's own counts against those of the texts."""
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    monkeypatch.setattr(brown_lm, "HEAD", 25)
    docs = documents()
    df = frame(spark, docs)
    model = train_model(df)
    table, k = plain_tables(model), model.k
    counts, histories, once = Counter(), Counter(), Counter()

    def history(w) -> int:
        return k + 1 if not w else int(model.classes[model.words[w]]) if w in model.words else k

    for r in docs:
        if not held_out(r[0]):
            tokens = words_of((r[1] or "").encode())
            counts.update(tokens)
    for r in docs:
        if not held_out(r[0]):
            tokens = [b"", *words_of((r[1] or "").encode()), b""]
            for a, b in zip(tokens, tokens[1:], strict=False):
                histories[history(a), table[b][1] if b else k] += 1
                once[history(a)] += counts[b] == 1 if b else 0
    assert {w: n for w, (n, _) in table.items()} == counts
    held = np.zeros((k + 2, k + 1))
    for (h, c), n in histories.items():
        held[h, c] = n
    overall = (held.sum(0) + 1e-3) / (held.sum() + 1e-3 * (k + 1))
    unknown = np.array([(once[h] + 20 * (sum(once.values()) + 1) / (held.sum() + 2)) / (held[h].sum() + 20) for h in range(k + 2)])
    following = (held + 20 * overall) / (held.sum(1, keepdims=True) + 20) * (1 - unknown)[:, None]
    mass = held[:, :k].sum(0)

    def plain(text) -> float:
        total, before = 0.0, b""
        for w in [*words_of((text or "").encode()), b""]:
            h = history(before)
            if not w:
                total += np.log10(following[h, k])
            elif w in table:
                n, c = table[w]
                total += np.log10(following[h, c] * n / mass[c])
            else:
                total += np.log10(unknown[h])
            before = w
        return total

    found = sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6)) for r in score_texts(df).collect())
    assert found == sorted((repr(r[0]), len(words_of((r[1] or "").encode())) + 1, round(float(plain(r[1])), 6)) for r in docs)


@pytest.mark.parametrize("frequent", [65_534, 30])
def test_probabilities_sum_to_one(spark, monkeypatch, frequent):
    """Over all words of training, the end and the unknown word, after every history."""
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    rng = random.Random(3)
    docs = [(k, prose(rng, 50), "en", "s", None) for k in range(60)]
    model = train_model(frame(spark, docs))
    table = plain_tables(model)
    total = 10.0**model.unknown + 10.0 ** model.transition[:, model.k]
    for n, c in table.values():
        total = total + 10.0 ** model.transition[:, c] * n / model.mass[c]
    assert np.allclose(total, 1) and model.train_types == len(table) + 1


@pytest.mark.parametrize("frequent", [65_534, 60])
def test_all_words_are_clustered_by_their_neighbours(spark, monkeypatch, frequent):
    """Words of two kinds that alternate: the kinds share no class, however rare a word is."""
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    monkeypatch.setattr(brown_lm, "HEAD", 20)
    monkeypatch.setattr(brown_lm, "LEAST_CLASSES", 4)
    monkeypatch.setattr(brown_lm, "MOST_CLASSES", 4)
    rng = random.Random(8)
    draw = lambda kind: f"{kind}{int(200 * rng.random() ** 3)}"
    docs = [(k, " ".join(draw("ab"[(i + k) % 2]) for i in range(200)), "en", "s", None) for k in range(100)]
    model = train_model(frame(spark, docs))
    table = plain_tables(model)
    right = Counter()
    for w, (n, c) in table.items():
        right[c, w[:1]] += n
    assert sum(max(right[c, b"a"], right[c, b"b"]) for c in range(4)) > 0.99 * sum(right.values())


def test_held_out_texts_score_above_the_base(spark):
    rng = random.Random(5)
    kinds = (["ka", "lo", "mi", "ten"], ["sur", "et", "or", "da"])
    docs = []
    for k in range(200):
        own = kinds[k % 2]
        docs.append((k, " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 2))) for _ in range(40)), "en", "s", None))
    found = [r for r in score_texts(frame(spark, docs)).collect() if r.held_out]
    assert found and sum(r.score for r in found) > sum(r.base_score for r in found) * 0.95


def test_empty_table(spark):
    assert score_texts(frame(spark, [])).collect() == []
