"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts come from all labelled training texts: each task adds up a matrix of
languages by hash buckets and one sum over tasks gives the whole, whose size
depends on the number of languages and buckets alone. The matrix of log
probabilities (float32) is broadcast; the bucket counts of a batch of texts are
the rows of a sparse matrix, which is multiplied with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Added to each bucket's count.
ALPHA = 0.5
UNDETERMINED = "und"
#: Characters that are hashed at once: of several texts, or of a piece of a longer one.
PIECE = 1 << 18
SPACE = 32
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def hashed_ngrams(kept: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of codes that begin at each place."""
    value = np.zeros(max(0, len(kept) - n + 1), np.uint64)
    for k in range(n):
        value = (value ^ kept[k : len(kept) - n + 1 + k]) * np.uint64(_MULTIPLIERS[k])
    value ^= value >> np.uint64(29)
    return (value * np.uint64(_MULTIPLIERS[n % 3]) >> np.uint64(64 - 15)).astype(np.int64)


_ALPHA_TABLE = np.zeros(0x110000, np.int8)  # 0: not asked yet, 1: letter, 2: other


def _letters(text: str, codes: np.ndarray) -> np.ndarray:
    state = _ALPHA_TABLE[codes]
    if (state == 0).any():
        for c in np.unique(codes[state == 0]).tolist():
            _ALPHA_TABLE[c] = 1 if chr(c).isalpha() else 2
        state = _ALPHA_TABLE[codes]
    return state == 1


def _single_spaces(codes: np.ndarray) -> np.ndarray:
    """codes with runs of spaces as one."""
    blank = codes == SPACE
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def ngrams_of_many(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of lower-cased texts: of letters, words padded by one space on both sides; all else counts as a space."""
    joined = " " + " \0 ".join(t.replace("\0", " ") if "\0" in t else t for t in lows) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _single_spaces(np.where(_letters(joined, codes), codes, np.where(codes == 0, 0, SPACE)).astype(np.uint64))
    row = np.cumsum(kept == 0)
    rows, buckets = [], []
    for n in ORDERS:
        if len(kept) < n:
            continue
        own = kept[: len(kept) - n + 1] != (SPACE if n == 1 else 0)
        for k in range(n):
            own &= kept[k : len(kept) - n + 1 + k] != 0  # none lies in two texts
        rows.append(row[: len(own)][own])
        buckets.append(hashed_ngrams(kept, n)[own])
    return np.concatenate(rows), np.concatenate(buckets)


def counts_of_long(low: str) -> np.ndarray:
    """Bucket counts of one lower-cased text, piece by piece: the last codes of a piece go on to the next, so that each n-gram counts once."""
    counts = np.zeros(BUCKETS, np.int64)
    carry = np.array([SPACE], np.uint64)
    for k in range(0, len(low), PIECE):
        piece = low[k : k + PIECE]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.where(_letters(piece, codes), codes, SPACE).astype(np.uint64)
        if k + PIECE >= len(low):
            new = np.append(new, np.uint64(SPACE))
        held = len(carry)
        kept = _single_spaces(np.concatenate([carry, new]))  # the carry has no runs, so its codes stay in place
        for n in ORDERS:
            first = max(0, held - n + 1)
            if k == 0:
                first = 0
            found = hashed_ngrams(kept[first:], n)
            if n == 1:
                found = found[kept[first:] != SPACE]
            counts += np.bincount(found, minlength=BUCKETS)
        carry = kept[-(max(ORDERS) - 1) :]
    return counts


def sparse_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket counts of texts as sparse rows, some texts at a time: their numbers, then starts, buckets (ascending in a row) and counts."""
    group: list[int] = []
    lows: list[str] = []
    held = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, bucket = ngrams_of_many(lows)
        cell, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
        starts = np.searchsorted(cell, np.arange(len(lows) + 1) * BUCKETS)
        return np.array(group), starts, cell % BUCKETS, counts

    for i, text in enumerate(texts):
        low = (text or "").lower()
        if len(low) > PIECE:
            counts = counts_of_long(low)
            at = np.flatnonzero(counts)
            yield np.array([i]), np.array([0, len(at)]), at, counts[at]
            continue
        if held + len(low) > PIECE and group:
            yield out()
            group, lows, held = [], [], 0
        group.append(i)
        lows.append(low)
        held += len(low)
    if group:
        yield out()


@dataclass(frozen=True)
class LanguageModel:
    """langs in order; log_prob: float32, a row for each language; log_prior: the share of training texts."""

    langs: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ties go to the first name. No letter: und, 0."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for group, starts, buckets, counts in sparse_counts(texts):
            some = np.flatnonzero(np.diff(starts))
            if not len(some):
                continue
            # the rows of the sparse matrix times the matrix of log probabilities
            total = np.add.reduceat(self.log_prob[:, buckets] * counts.astype(np.float64), starts[some], axis=1) + self.log_prior[:, None]
            best = total.argmax(0)
            score = 1.0 / np.exp(total - total.max(0)).sum(0)
            for i, language, s in zip(group[some].tolist(), best.tolist(), score.tolist(), strict=True):
                names[i], scores[i] = self.langs[language], s
        return names, scores


def train_language_model(labelled: DataFrame) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of labelled; rows where either is null, or a text without letters, teach nothing.

    No labelled text gives a model without languages, which answers und.
    """
    session_of(labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for group, starts, buckets, counts in sparse_counts(b.column(0).to_pylist()):
                for i, a, e in zip(group.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if e > a:
                        own = sums.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                        own[buckets[a:e]] += counts[a:e]
                        texts[langs[i]] = texts.get(langs[i], 0) + 1
        for key, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": [key] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(found[at], texts[key])})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    langs = tuple(sorted(set(sums["lang"].to_pylist())))
    place = {x: i for i, x in enumerate(langs)}
    counts, prior = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    i = np.array([place[x] for x in sums["lang"].to_pylist()], np.int64)
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    if len(langs):
        counts[i[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
        prior[i[bucket < 0]] = n[bucket < 0]
        prior = np.log(prior / prior.sum())
        counts = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS))
    return LanguageModel(langs, counts.astype(np.float32), prior)


def prediction(model: LanguageModel, text: Column, spark) -> Column:
    """A struct of lang_pred and score (the posterior, 0 to 1) for each text; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict([None if t is None or t != t else t for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text.cast("string"))


def predict_languages(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns keep of docs, then lang_pred and score.

    und, score 0: a null or empty text, or one without any letter. Equal texts
    get equal answers. Only ``text`` enters a prediction.
    """
    found = docs.select(*[docs[k] for k in keep], prediction(model, F.col("text"), session_of(docs)).alias("__found"))
    return found.select(*keep, "__found.lang_pred", "__found.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text is in one of the learned languages with a score of at least ``least``.

    The model learns from the rows whose fold of four is not 2. If nothing is
    labelled, texts that have a letter stay.
    """
    model = train_language_model(docs.where(fold(F.col("doc_id"), 4) != 2))
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    marked = docs.select(own, prediction(model, F.col("text"), session_of(docs)).alias("found"))
    return marked.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least)).select("record.*")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of a doc_id's text, modulo folds; a null id falls in fold 0 (that of no bytes)."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(folds))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the rows whose fold of four is not 2."""
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train_language_model(docs.where(~held_out))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict_languages(marked, model, "doc_id", "held_out")
