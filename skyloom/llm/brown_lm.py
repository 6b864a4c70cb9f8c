"""Brown class-based bigrams: exchange clustering of words, class transitions, word emissions, log10 scores of texts.

All words of training are clustered. Exchange clustering in sequence moves one of
the HEAD most frequent words after another to the class that raises the
likelihood of the class bigrams most, until none moves. All frequent words (up to
FREQUENT) are then exchanged at once, SWEEPS times: each goes to its best class
by its own counts of the classes before and after it, summed over the whole
corpus. Every other word of training goes to its best class by the classes before
it. The number of classes grows with the vocabulary.

A text's probability is the product over its tokens (words, then an end) of
P(class | history) * P(word | class). The history is the class of the token
before; rarer and unknown words are one history. Transitions are interpolated
with class frequencies; emissions are shares of the class's tokens. Words that
training never saw are one event, as in the base score, whose probability after
each history follows from how many of the words there occurred just once
(Good-Turing); the classes share the rest. So the probabilities of all words of
training, the end and the unknown word sum to 1 after every history.

The corpus is encoded once: two bytes for each token and the rarer words as they
are, in the shared folder; sweeps and scores read that. Counts of rarer words
stay distributed and meet the texts in a join by word, where no key is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, settle, shuffle_partitions
from .langid import fold
from .simhash import whole_groups

#: Words that are exchanged one by one, and frequent words: those with a place of two bytes.
HEAD = 2048
FREQUENT = 65_534
END_PLACE, RARE_PLACE = 0xFFFE, 0xFFFF
SWEEPS = 2
#: Classes: types to this power, within these bounds.
CLASS_POWER, LEAST_CLASSES, MOST_CLASSES = 0.3, 8, 96
#: Parts in which sums of frequent words are added up.
PARTS = 64
#: Words that a task counts before it passes them on, and rarer words that it places at once.
COUNTED_AT_ONCE = 300_000
PLACED_AT_ONCE = 20_000
#: Weight of overall frequencies among what follows a history, in tokens.
BACKOFF = 20.0
END = b""  # no word is empty
#: How often a word follows a history.
HELD = np.dtype([("history", "u1"), ("n", "<u4")])


def words_of(raw: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space."""
    return (raw or b"").lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes; empty: the end) and n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                found.update(words_of(text.as_py()))
                found[END] += 1
                if len(found) > COUNTED_AT_ONCE:
                    yield out()
                    found.clear()
        yield out()

    return train.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> pa.Table:
    """word and n of at most FREQUENT words, those with counts above a limit, most frequent first.

    The limit comes from a histogram of counts in steps of a 64th of a power of
    two, a few thousand rows for any corpus, so no task sorts the vocabulary.
    """
    words = counts.where(F.octet_length("word") > 0)
    power = F.length(F.bin("n")) - 1
    step = (power * 64 + F.floor(F.col("n") * 64.0 / F.pow(F.lit(2.0), power)) - 64).cast("int")
    rows = sorted(((r["step"], r["words"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    limit, held = None, 0
    for at, n in rows:
        if held + n > FREQUENT:
            break
        limit, held = at, held + n
    if limit is None:
        return pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    return words.where(step >= limit).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def encoded(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """key, doc_id, held_out, ids (two bytes for each word: its place, or RARE_PLACE) and rare (those words in order, joined by spaces) of every row of docs, settled."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, key = shared.value.get, TaskContext.get().partitionId() << 40
        for b in batches:
            ids, rare = [], []
            for text in b.column(2):
                words = words_of(text.as_py())
                own = np.fromiter(map(get, words, repeat(RARE_PLACE)), "<u2", len(words))
                ids.append(own.tobytes())
                rare.append(b" ".join([words[i] for i in np.flatnonzero(own == RARE_PLACE).tolist()]))
            keys = pa.array(np.arange(key, key + b.num_rows))
            key += b.num_rows
            yield pa.RecordBatch.from_arrays([keys, b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())], ["key", "doc_id", "held_out", "ids", "rare"])

    return settle(rows_in(docs).mapInArrow(encode, "key long, doc_id long, held_out boolean, ids binary, rare binary"), "encoded")


def rows_in(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("binary").alias("text"))


def sequence(ids: pa.Array) -> np.ndarray:
    """The places of a batch's texts, each one with an end before it and after it."""
    end = END_PLACE.to_bytes(2, "little")
    return np.frombuffer(end + end.join(ids.to_pylist()) + end, "<u2")


def summed(train: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], None], finish: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> pa.Table:
    """Sums over all texts, by parts. add: adds a sequence of places to a task's flat sums (size numbers); finish: what a part (its number and sums) becomes.

    A task passes on what isn't 0: 64 parts for any corpus, each one added up in one task.
    """
    width = -(-size // PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * PARTS, np.uint32)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                add(sums, sequence(b.column(0).slice(k, 2000)))
        for part in range(PARTS):
            own = sums[part * width : (part + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                n = own[at]
                kind = "<u1" if n.max() < 256 else "<u4"
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": [np.diff(at, prepend=0).astype("<u4").tobytes()], "n": [n.astype(kind).tobytes()]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            parts = group.column(0).to_numpy()
            for part in np.unique(parts).tolist():
                sums = np.zeros(width, np.int64)
                for k in np.flatnonzero(parts == part).tolist():
                    at, n = group.column(1)[k].as_py(), group.column(2)[k].as_py()
                    at = np.cumsum(np.frombuffer(at, "<u4"), dtype=np.int64)
                    sums[at] += np.frombuffer(n, "<u4" if len(n) == 4 * len(at) else "<u1")
                yield finish(part, sums)

    parts = train.select("ids").mapInArrow(count, "part int, at binary, n binary")
    return parts.repartition(min(PARTS, shuffle_partitions(train.sparkSession)), "part").sortWithinPartitions("part").mapInArrow(total, schema).toArrow()


def plain_sums(train: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sums themselves; size is bounded."""
    width = -(-size // PARTS)

    def finish(part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [sums.astype("<i8").tobytes()]})

    out = np.zeros(width * PARTS, np.int64)
    for part, sums in zip(*(c.to_pylist() for c in summed(train, size, add, finish, "part int, sums binary").columns), strict=True):
        out[part * width : (part + 1) * width] = np.frombuffer(sums, "<i8")
    return out[:size]


def unit_bigrams(train: DataFrame, head: int) -> np.ndarray:
    """How often each unit follows each unit: the first ``head`` words, all others, the end."""
    units = np.full(1 << 16, head, np.int64)
    units[:head] = np.arange(head)
    units[END_PLACE] = head + 1
    n = head + 2

    def add(sums: np.ndarray, places: np.ndarray) -> None:
        u = units[places]
        np.add.at(sums, u[:-1] * n + u[1:], np.uint32(1))

    return plain_sums(train, n * n, add).reshape(n, n)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 100, fixed: int = 1) -> np.ndarray:
    """Class of each unit; the last ``fixed`` units have the classes from ``classes`` on to themselves.

    The most frequent units start a class each; all others join, in order of
    frequency, the class that serves the likelihood of the class bigrams best.
    Then each sweep takes every unit out and puts it into its best class; ends
    when a sweep moves none.
    """
    n, k = len(bigrams), classes + fixed
    follow = bigrams.astype(np.float64)
    order = np.argsort(-(follow.sum(0) + follow.sum(1))[: n - fixed], kind="stable")
    of = np.full(n, -1, np.int64)
    right, left = np.zeros((n, k)), np.zeros((n, k))  # of each unit: tokens after and before it, by class
    joint = np.zeros((k, k))

    def shift(u: int, c: int, sign: int) -> None:
        """Puts a unit into a class, or takes it out."""
        if sign < 0:
            right[:, c] -= follow[:, u]
            left[:, c] -= follow[u]
        joint[c, :] += sign * right[u]
        joint[:, c] += sign * left[u]
        joint[c, c] += sign * follow[u, u]
        if sign > 0:
            right[:, c] += follow[:, u]
            left[:, c] += follow[u]

    def gains(u: int) -> np.ndarray:
        """Of putting a unit that is in no class into each; x ln x of counts, less that of their sums."""
        r, l_, own = right[u], left[u], follow[u, u]
        base, d = _f(joint), np.diagonal(joint)
        gain = (_f(joint + r) - base).sum(1) + (_f(joint + l_[:, None]) - base).sum(0)
        gain += _f(d + r + l_ + own) + _f(d) - _f(d + r) - _f(d + l_)
        row, col = joint.sum(1), joint.sum(0)
        # sums of rows and columns: those of the joined class, and those that the unit's neighbours add to
        gain -= _f(row + r.sum() + l_ + own) - _f(row + l_) + _f(col + l_.sum() + r + own) - _f(col + r)
        return gain[:classes]

    for f in range(fixed):
        of[n - fixed + f] = classes + f
        shift(n - fixed + f, classes + f, 1)
    for place, u in enumerate(order.tolist()):
        of[u] = place if place < classes else int(np.argmax(gains(u)))
        shift(u, of[u], 1)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            a = int(of[u])
            shift(u, a, -1)
            gain = gains(u)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            shift(u, b, 1)
            of[u] = b
            moved += a != b
        if not moved:
            break
    return of


def transitions(joint: np.ndarray, known: int) -> np.ndarray:
    """P(class | history) for histories (rows) and the first ``known`` columns, interpolated with the columns' frequencies."""
    own = joint[:, :known].astype(np.float64)
    overall = (own.sum(0) + 1e-3) / (own.sum() + 1e-3 * known)
    return (own + BACKOFF * overall) / (own.sum(1, keepdims=True) + BACKOFF)


def class_bigrams(train: DataFrame, context: np.ndarray, contexts: int) -> np.ndarray:
    """How often each context follows each context."""

    def add(sums: np.ndarray, places: np.ndarray) -> None:
        c = context[places].astype(np.int64)
        sums += np.bincount(c[:-1] * contexts + c[1:], minlength=len(sums)).astype(np.uint32)

    return plain_sums(train, contexts * contexts, add).reshape(contexts, contexts)


def contexts_of(classes: np.ndarray, k: int) -> np.ndarray:
    """Context of each place: classes of the first places, then k for all other words and k + 1 for the end."""
    context = np.full(1 << 16, k, np.uint8)
    context[: len(classes)] = classes
    context[END_PLACE] = k + 1
    return context


def exchange_all(train: DataFrame, words: int, context: np.ndarray, joint: np.ndarray, k: int) -> np.ndarray:
    """The best class of each frequent word by the contexts before and after it, given the class bigrams; all move at once."""
    c = k + 2
    per_part = -(-words // PARTS)
    before = np.log(transitions(joint, c))  # of a class after each context
    after = before.T  # rows: what follows a class
    size = np.log(joint[:, :k].sum(0) + 1.0)

    def add(sums: np.ndarray, places: np.ndarray) -> None:
        at = np.flatnonzero(places < END_PLACE)
        at = at[places[at] < words]
        word, ctx = places[at].astype(np.int64) * (2 * c), context[places]
        np.add.at(sums, word + ctx[at - 1], np.uint32(1))
        np.add.at(sums, word + c + ctx[at + 1], np.uint32(1))

    def finish(part: int, sums: np.ndarray) -> pa.RecordBatch:
        own = sums.reshape(per_part, 2, c).astype(np.float64)
        left, right = own[:, 0], own[:, 1]
        gain = left @ before[:, :k] + right @ after[:, :k] - left.sum(1, keepdims=True) * size
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "classes": [gain.argmax(1).astype(np.uint8).tobytes()]})

    found = summed(train, per_part * PARTS * 2 * c, add, finish, "part int, classes binary")
    out = np.zeros(per_part * PARTS, np.uint8)
    for part, classes in zip(*(x.to_pylist() for x in found.columns), strict=True):
        out[part * per_part : (part + 1) * per_part] = np.frombuffer(classes, np.uint8)
    return out[:words]


def rare_words(train: DataFrame, context: np.ndarray, joint: np.ndarray, k: int) -> DataFrame:
    """word, n, class and histories (HELD for each) of every word of training that isn't frequent, settled."""
    spark = train.sparkSession
    before = np.log(transitions(joint, k))
    size = np.log(joint[:, :k].sum(0) + 1.0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                places = sequence(part.column(0))
                at = np.flatnonzero(places == RARE_PLACE)
                words = b" ".join([x for x in part.column(1).to_pylist() if x]).split()
                own = pa.table([pa.array(words, pa.binary()), pa.array(context[places[at - 1]].astype(np.int16))], ["word", "history"])
                yield from own.group_by(["word", "history"]).aggregate([([], "count_all")]).combine_chunks().to_batches()

    rows = train.select("ids", "rare").mapInArrow(emit, "word binary, history short, count_all long")
    dealt = rows.repartition(shuffle_partitions(spark), "word").sortWithinPartitions("word")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(i, PLACED_AT_ONCE) for b in batches for i in range(0, b.num_rows, PLACED_AT_ONCE))
        for b in whole_groups(small):
            coded = b.column(0).dictionary_encode()
            at, words = coded.indices.to_numpy(), coded.dictionary
            left = np.zeros((len(words), k + 2))
            np.add.at(left, (at, b.column(1).to_numpy()), b.column(2).to_numpy())
            best = (left @ before - left.sum(1, keepdims=True) * size).argmax(1)
            row, history = np.nonzero(left)
            held = np.zeros(len(row), HELD)
            held["history"], held["n"] = history, left[row, history]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]) * HELD.itemsize
            histories = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(held.tobytes())])
            yield pa.RecordBatch.from_arrays([words, pa.array(left.sum(1).astype(np.int64)), pa.array(best.astype(np.int32)), histories], ["word", "n", "class", "histories"])

    return settle(dealt.mapInArrow(place, "word binary, n long, class int, histories binary"), "rare-words")


def rare_sums(rare: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rarer words: tokens by history and class, and tokens by history of words that occurred once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((k + 2, k + 1), np.int64)  # the last column: words that occurred once
        for b in batches:
            held = np.frombuffer(b"".join(b.column(2).to_pylist()), HELD)
            row = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column(2)).to_numpy() // HELD.itemsize)
            np.add.at(joint, (held["history"], b.column(1).to_numpy()[row]), held["n"])
            once = b.column(0).to_numpy()[row] == 1
            np.add.at(joint, (held["history"][once], k), held["n"][once])
        flat = joint.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": flat[at]})

    found = rare.select("n", "class", "histories").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # histories x classes at most
    total = np.zeros((k + 2) * (k + 1), np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    total = total.reshape(k + 2, k + 1)
    return total[:, :k], total[:, k]


@dataclass(frozen=True)
class ClassModel:
    """All that scoring needs but the table of rarer words; its size is bounded.

    words: place of each frequent word; counts: theirs; classes: theirs; k: the
    number of classes (k is the history of all other words, k + 1 the end);
    transition: log10 P(class or, in the last column, the end | history), all
    known; unknown: log10 P(a word that training never saw | history); mass: tokens of each class.
    """

    words: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    k: int
    transition: np.ndarray
    unknown: np.ndarray
    mass: np.ndarray
    ends: int
    train_tokens: int
    train_types: int
    rare: DataFrame
    encoded: DataFrame


def classes_for(types: int) -> int:
    return int(np.clip(round(types**CLASS_POWER), LEAST_CLASSES, MOST_CLASSES))


def train_model(docs: DataFrame) -> ClassModel:
    """The model, from the rows whose fold of seven is not 2; null texts are empty."""
    session_of(docs)
    counts = settle(word_counts(rows_in(docs).where("not held_out").select("text")), "word-counts")
    tokens, types, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    top = frequent_words(counts)
    words = {w: i for i, w in enumerate(top["word"].to_pylist())}
    rows = encoded(docs, words)
    train = rows.where("not held_out")
    head, k = min(HEAD, len(words)), classes_for(types)
    bigrams = unit_bigrams(train, head)
    unit_class = exchange(bigrams, k, fixed=2)
    member = np.zeros((head + 2, k + 2))
    member[np.arange(head + 2), unit_class] = 1.0
    joint = member.T @ bigrams @ member
    classes, context = unit_class[:head].astype(np.uint8), contexts_of(unit_class[:head], k)
    for _ in range(SWEEPS if len(words) else 0):
        classes = exchange_all(train, len(words), context, joint, k)
        context = contexts_of(classes, k)
        joint = class_bigrams(train, context, k + 2).astype(np.float64)
    rare = rare_words(train, context, joint, k)
    by_rare, once = rare_sums(rare, k)
    once = once + _once(train, context, top["n"].to_numpy(), k)
    held = np.concatenate([joint[:, :k] + by_rare, joint[:, k + 1 :]], axis=1)
    known = held.sum(1)
    unknown = (once + BACKOFF * (once.sum() + 1) / (known.sum() + 2)) / (known + BACKOFF)
    transition = transitions(held, k + 1) * (1 - unknown)[:, None]
    mass = held[:, :k].sum(0)
    return ClassModel(words, top["n"].to_numpy(), classes, k, np.log10(transition), np.log10(unknown), mass, int(ends), int(tokens), int(types), rare, rows)


def _once(train: DataFrame, context: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Tokens by history of frequent words that occurred once (where a vocabulary is small)."""
    single = np.zeros(1 << 16, bool)
    single[: len(counts)] = counts == 1
    if not single.any():
        return np.zeros(k + 2, np.int64)

    def add(sums: np.ndarray, places: np.ndarray) -> None:
        sums += np.bincount(context[places[:-1]][single[places[1:]]], minlength=len(sums)).astype(np.uint32)

    return plain_sums(train, k + 2, add)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Null, empty and blank texts are the end alone. Equal texts get equal scores,
    repeated rows a row each, null ids are in training (fold of no bytes). No
    rows give no rows. Scores are sums of log10 probabilities, so below 0. Very
    long texts are read whole.
    """
    m = train_model(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((m.counts, m.classes, m.k, m.transition, m.unknown, m.mass, m.ends, m.train_tokens, m.train_types))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes, k, transition, unknown, mass, ends, n, v = shared.value
        context, words = contexts_of(classes, k), len(counts)
        base = np.zeros(1 << 16)
        base[:words] = np.log10((counts + 1) / (n + v + 1))
        base[END_PLACE] = np.log10((ends + 1) / (n + v + 1))
        emission, column = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
        emission[:words], column[:words], column[END_PLACE] = np.log10(counts / mass[classes]), classes, k
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("key", "word", "n", "history", "doc")}
            for key, doc_id, held_out, ids, rare in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = np.append(np.frombuffer(ids, "<u2"), np.uint16(END_PLACE))
                before = context[np.append(np.uint16(END_PLACE), places[:-1])]
                at = places != RARE_PLACE
                seen = places[at]
                doc = {
                    "doc_id": doc_id, "held_out": held_out, "n_tokens": len(places), "n_known": len(seen) - (not ends), "base": float(base[seen].sum()),
                    "score": float(transition[before[at], column[seen]].sum() + emission[seen].sum()),
                }
                tail = Counter(zip(rare.split(), before[~at].tolist(), strict=True))
                out["key"] += [key] * (len(tail) + 1)
                out["word"] += [b"%d " % key, *(w for w, _ in tail)]  # no word holds a space: the text's own row meets no count
                out["n"] += [0, *tail.values()]
                out["history"] += [0, *(h for _, h in tail)]
                out["doc"] += [doc, *repeat(None, len(tail))]
            kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
            columns = [pa.array(out["key"], pa.int64()), pa.array(out["word"], pa.binary()), pa.array(out["n"], pa.int32()), pa.array(out["history"], pa.int32()), pa.array(out["doc"], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "history", "doc"])

    pieces = m.encoded.select("key", "doc_id", "held_out", "ids", "rare").mapInArrow(
        score, "key long, word binary, n int, history int, doc struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, score: double>"
    )
    met = pieces.join(m.rare.select("word", F.col("n").alias("c"), "class"), "word", "left")
    tokens = float(m.train_tokens + m.train_types + 1)
    # small tables as arrays: histories by classes, histories, classes
    flat = lambda x: F.expr(f"array({', '.join(f'{float(y)!r}D' for y in np.asarray(x).ravel())})")
    within = F.get(flat(m.transition[:, : m.k]), F.col("history") * m.k + F.col("class")) + F.log10(F.col("c") / F.get(flat(m.mass), F.col("class")))
    own = F.when(F.col("c").isNull(), F.get(flat(m.unknown), F.col("history"))).otherwise(within)
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(tokens))
    sums = met.groupBy("key").agg(
        F.max("doc").alias("doc"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * base).alias("base"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * own).otherwise(0.0)).alias("tail"),
    )
    return sums.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.n_known") + F.col("known")).cast("long").alias("n_known"), F.lit(m.train_tokens).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("base")).alias("base_score"), (F.col("doc.score") + F.col("tail")).alias("score"),
    )
