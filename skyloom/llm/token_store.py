"""Token-ID output: documents in ascending doc_id order, their ids in one concatenated array, boundaries in Elias-Fano code.

A store is a folder of shard files, one for each range of doc_id, plus a
manifest (shard, docs, tokens, first token). A shard file holds, in this order:
the ids (little-endian, 2 bytes where the vocabulary allows, else 4), the doc
ids (8 bytes each, those of null ids first and counted in the footer), the low
bits, the high bits and the select samples of the Elias-Fano code of the
n_docs + 1 boundaries, and a footer of fixed length.

Elias-Fano keeps n ascending values below u in about n * (2 + log2(u / n)) bits:
the low bits of each value packed side by side, the high bits in unary. Every
256th one of the unary part has its place kept, so ``select(i)`` reads a few
bytes. Readers select the boundaries of some documents at a time; no table of
64-bit offsets exists.
"""

from __future__ import annotations

import json
import string
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, shuffle_partitions, work_path

MAGIC = b"SKYLEFT1"
FOOTER = struct.Struct("<8Q8s")
SAMPLE = 256
#: Bytes of the words and ids that a worker keeps in each of two generations: when the younger is full it becomes the older, which hands back what is asked for again.
#: ENTRY: what Python takes for a word besides its letters and ids, about.
CACHED_BYTES, ENTRY = 24 << 20, 140
#: Runs of punctuation that are kept besides, and the longest one.
KEPT_ENDS, LONGEST_END = 10_000, 64
#: Below this character, letters stay single letters in NFC and lower case, but for the dotted capital I.
LAST_SIMPLE, DOTTED_I = "\u0250", "\u0130"
#: The least byte of UTF-8 that only characters from LAST_SIMPLE on have; combining marks are all there.
NOT_SIMPLE = 0xCA
MARKS = string.punctuation.encode()
CHUNK_TOKENS = 1 << 20
ENCODED_AT_ONCE = 1 << 19
#: Values whose low bits are packed at once (a multiple of 8), and documents whose boundaries are selected at once.
PACKED_AT_ONCE, READ_AT_ONCE = 1 << 16, 4096


class EliasFano:
    """An ascending sequence in near-minimal space with select(i) -> its i-th value."""

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.lows, self.highs = np.frombuffer(lows, np.uint8), np.frombuffer(highs, np.uint8)
        self.samples = np.frombuffer(samples, "<u4" if len(samples) == 4 * self._count(n) else "<u8")

    @staticmethod
    def _count(n: int) -> int:
        return -(-n // SAMPLE)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: ascending, not negative, at least one."""
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        lows = []
        for k in range(0, n if low_bits else 0, PACKED_AT_ONCE):  # a whole number of bytes each
            lows.append(np.packbits(((values[k : k + PACKED_AT_ONCE, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        samples = places[::SAMPLE].astype("<u4" if places[-1] < 1 << 32 else "<u8")
        return cls(n, low_bits, b"".join(lows), np.packbits(bits, bitorder="little").tobytes(), samples.tobytes())

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.lows.tobytes(), self.highs.tobytes(), self.samples.tobytes()

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        piece = self.lows[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(piece, "little") >> (start & 7) & ((1 << self.low_bits) - 1)

    def _place(self, i: int) -> int:
        """Where the i-th one of the unary part is: from the sample before it, by bytes and their bit counts."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            at = place + 1
            byte = at >> 3
            window = int(self.highs[byte]) >> (at & 7) << (at & 7)
            while (ones := window.bit_count()) < left:
                left -= ones
                byte += 1
                window = int(self.highs[byte])
            for _ in range(left - 1):
                window &= window - 1
            place = byte * 8 + (window & -window).bit_length() - 1
        return place

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self._place(i) - i) << self.low_bits | (self._low(i) if self.low_bits else 0)

    def select_many(self, first: int, end: int) -> np.ndarray:
        """The values from the first-th on, before the end-th: selects both ends and reads the bits between."""
        if not 0 <= first <= end <= self.n:
            raise IndexError((first, end))
        if first == end:
            return np.zeros(0, np.int64)
        a, b = self._place(first), self._place(end - 1)
        start = a >> 3
        places = np.flatnonzero(np.unpackbits(self.highs[start : (b >> 3) + 1], bitorder="little")) + 8 * start
        places = places[(places >= a) & (places <= b)]
        values = (places - np.arange(first, end)) << self.low_bits
        if self.low_bits:
            bit = first * self.low_bits
            raw = np.unpackbits(self.lows[bit >> 3 : (end * self.low_bits + 7) >> 3], bitorder="little")[bit & 7 :]
            bits = raw[: (end - first) * self.low_bits].reshape(end - first, self.low_bits)
            values |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return values


class WordEncoder:
    """Ids of whole texts as bytes, little-endian.

    Where the tokenizer drops white space and never joins over it, each word's
    ids are found once by the library and kept; a text's ids are then its
    words' ids in order. Simple texts are lower-cased first if the tokenizer does
    so itself. All other tokenizers get whole texts.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        spec = json.loads(tokenizer_json)
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        self.by_word = drops_white_space(spec)
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.lower_special = [t.lower() for t in self.special]
        if any(len(t.split()) != 1 or t.split()[0] != t for t in self.special):
            self.by_word = False
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cached = 0
        self.ends: dict[bytes, bytes] = {}
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.is_end = np.zeros(size, bool)
        if suffix:
            self.is_end[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.in_parts = self.by_word and self.lowers and bool(suffix) and spec["model"].get("type") == "BPE"

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _cores(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs of letters, each one pre-token: ASCII ones by the library's model at once, others joined by spaces and cut at word ends."""
        found = {c: self._pack([t.id for t in self.tokenizer.model.tokenize(c.decode())]) for c in cores if c.isascii()}
        rest = [c for c in cores if not c.isascii()]
        if not rest:
            return found
        groups = [rest[k : k + 200] for k in range(0, len(rest), 200)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(own):
                raise ValueError("a run of letters is not one pre-token")
            raw, width = ids.tobytes(), self.dtype.itemsize
            found.update((c, raw[a * width : b * width]) for c, a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, by the library; kept if there is room.

        A word that is letters and then ASCII punctuation is two pre-tokens, and
        many words share either; the letters are kept as a word of their own. All
        others are encoded whole.
        """
        found: dict[bytes, bytes] = {}
        split: list[tuple[bytes, bytes, bytes]] = []
        odd: list[bytes] = []
        new: set[bytes] = set()
        older, cache = self.older.get, self.cache.get
        for w in words:
            ids = older(w)
            if ids is not None:
                found[w] = ids
                continue
            core = w.rstrip(MARKS)
            end = w[len(core) :]
            if core.isalpha():  # bytes: ASCII letters only
                core = core.lower()
            elif not self._is_simple_run(core):
                odd.append(w)
                continue
            if not self.in_parts:
                odd.append(w)
                continue
            ids = cache(core) or older(core)
            if ids is None:
                new.add(core)
                split.append((w, core, end))
            else:
                found[w] = ids + self._end(end) if end else ids
        if new:
            found.update(self._cores(list(new)))
        for w, core, end in split:
            ids = found[core]
            found[w] = ids + self._end(end) if end else ids
        for k in range(0, len(odd), 8192):
            some = odd[k : k + 8192]
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            found.update((w, self._pack(e.ids)) for w, e in zip(some, got, strict=True))
        size = ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        if self.cached + size > CACHED_BYTES:
            self.older, self.cache, self.cached = self.cache, {}, 0
        if size <= CACHED_BYTES:
            self.cache.update(found)
            self.cached += size
        return found

    @staticmethod
    def _is_simple_run(core: bytes) -> bool:
        """Whether it is letters below LAST_SIMPLE, without the dotted capital I."""
        text = core.decode("utf-8", "replace")
        return text.isalpha() and max(text) < LAST_SIMPLE and DOTTED_I not in text

    def _end(self, end: bytes) -> bytes:
        ids = self.ends.get(end)
        if ids is None:
            ids = self._pack(self.tokenizer.encode(end.decode(), add_special_tokens=False).ids)
            if len(self.ends) > KEPT_ENDS:
                self.ends.clear()
            if len(end) <= LONGEST_END:
                self.ends[end] = ids
        return ids

    def _words(self, text: bytes) -> list[bytes]:
        """Simple texts are lower-cased first: each of their letters stays one letter, so A-Z can go before all others."""
        if self.lowers and (text.isascii() or np.frombuffer(text, np.uint8).max() < NOT_SIMPLE):
            low = text.lower()
            if not any(t in low for t in self.lower_special):
                text = low
        return text.split()

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; what is new in any of them is learned at once."""
        if not self.by_word:
            return [self._pack(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids) for t in texts]
        words = [self._words(t) for t in texts]
        parts = [list(map(self.cache.get, w)) for w in words]
        missing = [[i for i, p in enumerate(own) if p is None] if None in own else [] for own in parts]
        unknown = {w[i] for w, at in zip(words, missing, strict=True) for i in at}
        if unknown:
            found = self._learn(list(unknown))
            for w, own, at in zip(words, parts, missing, strict=True):
                for i in at:
                    own[i] = found[w[i]]
        return [b"".join(own) for own in parts]


def groups_of(column: pa.Array, most: int = ENCODED_AT_ONCE) -> Iterator[list[bytes]]:
    """Texts (null: empty) in groups of at most so many bytes; a longer text is its own group."""
    own: list[bytes] = []
    held = 0
    for value in column:
        text = value.as_py() or b""
        if own and held + len(text) > most:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text)
    if own:
        yield own


def drops_white_space(spec: dict) -> bool:
    """Whether the pre-tokenizer keeps only runs without white space, so that words can be encoded apart."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and pattern.endswith("[^\\s\\p{L}\\p{N}]+")
        and not any(s.get("add_prefix_space") for s in steps)
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
    )


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """One for each worker process."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Frees what this worker keeps for encoding: by the time a store is read, all of it is written."""
    _ENCODERS.clear()


def write_shard(path: str, batches: Iterable[pa.RecordBatch], encode: WordEncoder, end_id: int) -> tuple[int, int]:
    """Documents and tokens of one shard, written under another name and moved into place, so that a repeated task is harmless."""
    store, target = fs.FileSystem.from_uri(path)
    store.create_dir(target.rpartition("/")[0], recursive=True)
    draft = f"{target}.{np.random.default_rng().integers(1 << 62):x}.draft"
    end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
    doc_ids: list[np.ndarray] = []
    lengths = array("q")
    nulls = tokens = 0
    with store.open_output_stream(draft, buffer_size=1 << 20) as out:
        for batch in batches:
            ids = batch.column(0)
            nulls += ids.null_count
            doc_ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for texts in groups_of(batch.column(1)):
                for ids_of_text in encode.encode_many(texts):
                    out.write(ids_of_text + end)
                    lengths.append(len(ids_of_text) // width + 1)
        bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))]).astype(np.int64)
        tokens = int(bounds[-1])
        code = EliasFano.of(bounds)
        sections = [b"".join(x.tobytes() for x in doc_ids), *code.parts()]
        for section in sections:
            out.write(section)
        out.write(FOOTER.pack(len(lengths), tokens, width, nulls, code.low_bits, *map(len, sections[1:]), MAGIC))
    store.move(draft, target)
    return len(lengths), tokens


class Shard:
    """Reads one shard file: whole, or one document by select."""

    def __init__(self, path: str):
        store, target = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(target)
        end = self.file.size() - FOOTER.size
        self.n, self.tokens, self.width, self.nulls, low_bits, *sizes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.dtype = np.dtype(f"<u{self.width}")
        at = end - sum(sizes)
        parts = []
        for size in sizes:
            parts.append(self.file.read_at(size, at))
            at += size
        self.bounds = EliasFano(self.n + 1, low_bits, *parts)

    def doc_ids(self) -> np.ma.MaskedArray:
        raw = np.frombuffer(self.file.read_at(8 * self.n, self.tokens * self.width), "<i8")
        return np.ma.MaskedArray(raw, np.arange(self.n) < self.nulls)

    def ids(self, first: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - first) * self.width, first * self.width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class TokenStore:
    """path: the folder; shards: (file name, docs, tokens, first token) in ascending order of doc_id."""

    path: str
    shards: tuple[tuple[str, int, int, int], ...]


def write_token_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, shards: int | None = None) -> TokenStore:
    """Encodes ``doc_id``, ``text`` of docs and writes a store; other columns are not read.

    Null texts are empty: their ids are the end id alone. Null doc ids come
    first, repeated ones lie side by side in the order of their texts. An empty
    table gives a store without shards. Texts move once, in a range
    partitioning by doc_id; each task writes its file as a stream.
    """
    spark = session_of(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    path = path or work_path(spark, "tokens")
    n = shards or shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"shard-{part:06d}.ids"

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        docs_n, tokens_n = write_shard(f"{path}/{name}", rest(), encoder(spec.value), end_id)
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [docs_n], "tokens": [tokens_n]})

    written = sorted(ordered.mapInArrow(write, "part long, name string, docs long, tokens long").collect())  # one row for each shard
    starts = np.concatenate([[0], np.cumsum([w.tokens for w in written], dtype=np.int64)]) if written else [0]
    return TokenStore(path, tuple((w.name, w.docs, w.tokens, int(s)) for w, s in zip(written, starts, strict=False)))


def read_token_store(spark, store: TokenStore, with_ids: bool = False) -> DataFrame:
    """One row for each document from a store's files: doc_id, start (ids before it), n_tokens, ids_crc32, and with with_ids its ids."""
    path, schema = store.path, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not store.shards:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(name, first) for name, _, _, first in store.shards], "name string, first long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(f"{path}/{name}")
                doc_ids, at = shard.doc_ids(), 0
                while at < shard.n:
                    bounds = shard.bounds.select_many(at, min(at + READ_AT_ONCE, shard.n) + 1)
                    held = max(1, int(np.searchsorted(bounds, bounds[0] + CHUNK_TOKENS, "right")) - 1)
                    bounds, end = bounds[: held + 1], at + held
                    ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    cuts = bounds - bounds[0]
                    pieces = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    columns = [
                        pa.array(doc_ids.data[at:end], pa.int64(), mask=np.ma.getmaskarray(doc_ids)[at:end]),
                        pa.array(bounds[:-1] + first, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    at = end
                shard.close()

    return names.repartition(len(store.shards)).mapInArrow(read, schema)
