from __future__ import annotations

import math
import random
import zlib

import numpy as np

from skyloom.llm import langid
from skyloom.llm.langid import identify_languages, keep_identified, sparse_counts, train_language_model

from .helpers import documents, frame

SOUNDS = {"en": ["the", "ing", "and", "wh", "er"], "fr": ["eau", "ou", "é", "ç", "ment"], "de": ["sch", "ung", "ß", "ü", "ver"]}


def text(lang: str, rng: random.Random) -> str:
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 30)))


def table(n: int = 200):
    rng = random.Random(7)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((k, text(lang, rng), lang if rng.random() < 0.9 else None, "s", None))
    return rows


def counted(texts: list) -> list[np.ndarray]:
    out = [np.zeros(langid.BUCKETS, np.int64) for _ in texts]
    for group, starts, buckets, counts in sparse_counts(texts):
        for i, a, e in zip(group, starts, starts[1:], strict=False):
            out[i][buckets[a:e]] += counts[a:e]
    return out


def plain_ngrams(text: str | None) -> list[str]:
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = f" {' '.join(low.split())} " if low.split() else ""
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def test_counts_are_those_of_the_ngrams():
    """As many as a plain reading finds, and the same bucket for the same n-gram, in whatever company."""
    texts = ["aé ß, a", "", None, "x", " \0a\0 b ", "12", "ΑΣ ΑΣ", "one two"]
    found = counted(texts)
    assert [int(f.sum()) for f in found] == [len(plain_ngrams(t)) for t in texts]
    for t, f in zip(texts, found, strict=True):
        alone = counted([t])[0]
        assert (alone == f).all()
        assert len(np.flatnonzero(f)) <= len(set(plain_ngrams(t)))
    assert (counted(["one two"])[0] == counted(["ONE -- two"])[0]).all()


def test_held_out_accuracy(spark):
    rows = table()
    truth = {r[0]: r[2] for r in rows}
    found = identify_languages(frame(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r for r in found if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged)


def test_model_is_naive_bayes(spark):
    rows = table(60)
    model = train_language_model(frame(spark, rows))
    counts = {lang: np.zeros(langid.BUCKETS) for lang in SOUNDS}
    texts = dict.fromkeys(SOUNDS, 0)
    for r in rows:
        if r[2]:
            counts[r[2]] += counted([r[1]])[0]
            texts[r[2]] += 1
    for lang, row, prior in zip(model.langs, model.log_prob, model.log_prior, strict=True):
        plain = np.log((counts[lang] + langid.ALPHA) / (counts[lang].sum() + langid.ALPHA * langid.BUCKETS))
        assert np.allclose(row, plain, atol=1e-5) and math.isclose(prior, math.log(texts[lang] / sum(texts.values())))


def test_hard_texts(spark):
    found = {r.doc_id: r for r in identify_languages(frame(spark, documents())).collect() if r.doc_id is not None}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (40, 41, 42, 43))
    assert found[44].lang_pred in ("en", "fr")
    assert identify_languages(frame(spark, [])).collect() == []


def test_nothing_labelled(spark):
    rows = [(1, "some text", None, "s", None), (2, None, None, "s", None), (3, "12", None, "s", None)]
    assert {r.lang_pred for r in identify_languages(frame(spark, rows)).collect()} == {"und"}
    assert [r.doc_id for r in keep_identified(frame(spark, rows)).collect()] == [1]


def test_kept_rows(spark):
    rows = [*table(50), (900, None, "en", "s", None), (901, "--", "en", "s", None)]
    df = frame(spark, rows, extra=True)
    kept = keep_identified(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {900, 901} and len(ids) >= 48


def test_long_texts_are_read_whole(monkeypatch):
    """Piece by piece, every n-gram counts once, over the cuts too."""
    rng = random.Random(2)
    texts = ["aé ß" * 1000, "  a", "x" * 333, " - " * 100, "".join(rng.choice("ab é,İΣ\0") for _ in range(5000))]
    whole = counted(texts)
    for piece in (1, 2, 3, 7, 50, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(counted(texts), whole, strict=True))


def test_scores_do_not_depend_on_the_way(spark, monkeypatch):
    rows = table(80)
    model = train_language_model(frame(spark, rows))
    texts = [r[1] for r in rows] + [None, "", "12"]
    names, scores = model.predict(texts)
    monkeypatch.setattr(langid, "PIECE", 10)
    again, scores_again = model.predict(texts)
    assert names == again and scores.tolist() == scores_again.tolist()
    assert names[-3:] == ["und"] * 3


def test_clashing_columns_stay(spark):
    df = frame(spark, table(30)).selectExpr("*", "'mine' AS `its language`", "'mine' AS found", "'mine' AS record")
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r["its language"] for r in kept.collect()} == {"mine"}
