from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import token_store
from skyloom.llm.token_store import EliasFano, Shard, WordEncoder, read_token_store, write_token_store

from .helpers import documents, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as _f:
    SPEC = _f.read()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=700))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), np.int64)
    code = EliasFano.of(values)
    again = EliasFano(code.n, code.low_bits, *code.parts())
    assert (again.select_many(0, len(values)) == values).all()
    for first in range(0, len(values), 37):
        for end in (first, first + 1, min(len(values), first + 50), len(values)):
            assert again.select_many(first, end).tolist() == values[first:end].tolist()
    assert [again.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        again.select(len(values))


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 30, 50_000))
    bits = 8 * sum(map(len, EliasFano.of(values).parts())) / len(values)
    assert bits < 2.2 + np.log2((1 << 30) / 50_000) + 0.5


ODD = ["", "  ", "Don't STOP's 'S it'LL", "á É H̱x Ṩ", "<|endoftext|> x<|EndOfText|>y", "ΑΣ. İstanbul İ.", "a\x1cb\x85c　d\x0be", "x1y2 ٣ ...!!! 你好,世界。 ½ ǅ", "ß ẞ ﬁ", "don' e‍x", "ŉ. ſt, क़."]


def test_words_apart_are_the_text_whole():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    own, plain = WordEncoder(spec), tokenizers.Tokenizer.from_str(spec)
    rng = random.Random(1)
    letters = "aBcÀéœßİıſ'.,-!1٣ \t\n你ж́ |<>"
    for text in ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]:
        expected = np.array(plain.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        assert own.encode(text.encode()) == expected, text


def test_simple_letters_are_lower_cased_apart(monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_BYTES", 20_000)  # words come and go
    own, plain = WordEncoder(SPEC), tokenizers.Tokenizer.from_str(SPEC)
    texts = [f"A{c}B. X{c}!! {c}K ab'S {c}. Ab, KEPT. kept!! {''.join(map(chr, range(k, k + 9)))}A" for k, c in enumerate(map(chr, range(0x80, 0x260)), 0x80)]
    expected = [np.array(e.ids, "<u2").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert own.encode_many([t.encode() for t in texts]) == expected
    assert [own.encode(t.encode()) for t in texts] == expected


def test_kept_words_are_bounded_by_bytes():
    own, rng = WordEncoder(SPEC), random.Random(3)
    for _ in range(25):
        own.encode(" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) + rng.choice(".,!") for _ in range(10_000)).encode())
    kept = [d for d in vars(own).values() if isinstance(d, dict)]
    assert sum(sys.getsizeof(d) + sum(map(sys.getsizeof, d)) + sum(map(sys.getsizeof, d.values())) for d in kept) < 56 << 20


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = WordEncoder(f.read())
    assert not own.by_word
    assert own.encode(b"two  words")


def expected_rows(docs):
    plain = tokenizers.Tokenizer.from_file(PATH)
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for r in ordered:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_low_bits_are_packed_in_parts(monkeypatch):
    values = np.cumsum(np.random.default_rng(2).integers(0, 1 << 20, 1000))
    whole = EliasFano.of(values).parts()
    monkeypatch.setattr(token_store, "PACKED_AT_ONCE", 64)
    assert EliasFano.of(values).parts() == whole


@pytest.mark.parametrize(("shards", "at_once"), [(1, 4096), (5, 4096), (2, 3)])
def test_store(spark, monkeypatch, shards, at_once):
    monkeypatch.setattr(token_store, "READ_AT_ONCE", at_once)
    docs = documents()
    store = write_token_store(frame(spark, docs, extra=True), PATH, shards=shards)
    found = sorted((tuple(r) for r in read_token_store(spark, store).collect()), key=lambda r: r[1])
    assert found == expected_rows(docs)
    with_ids = read_token_store(spark, store, with_ids=True).where("start = 0").first()
    assert len(with_ids.ids) == with_ids.n_tokens
    name, n, _, first = store.shards[0]
    shard = Shard(f"{store.path}/{name}")
    assert [len(shard.document(i)) for i in range(n)] == [r[2] for r in found if r[1] >= first][:n]


def test_empty_table(spark):
    store = write_token_store(frame(spark, []), PATH)
    assert read_token_store(spark, store).collect() == []
