"""SimHash near-duplicates: exact comparison in tiles, by exclusive or and bit counts in numpy.

Rows with a fingerprint that share a key are compared: sorted by key and
population count, they are cut into tiles, and each tile meets itself and those
after it as long as they share a key and their population counts are within the
radius; all other tile pairs are skipped. Every link comes from a tile pair.

Keys of a narrow radius r lose no pair: two fingerprints that differ in at most r
bits agree wholly in at least m - r of m parts of their bits, so keys are the
possible choices of m - r parts; m grows with the number of fingerprints, so that
a key holds about a tile. A key of more rows is dealt out as pairs of ranges in
the order of population counts, each pair a group of bounded size.

``similar_components`` asks for a similarity of shingle sets instead. Fingerprints
of such pairs differ in so many bits that parts of them select nothing, so keys
are bands of min-wise shingle hashes, the tiles take a wide radius, and what they
find is verified on the whole sets.

A group gives one edge for each node that has a link, to the smallest of its
component within the group; components over all groups come from the alternating
large-star and small-star steps, on nodes that have links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, settle, shuffle_partitions

WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Rows of one key that are compared in one group, and rows of a tile.
GROUP = 2048
TILE = 256
CHUNK = 1 << 16

#: For a similarity of shingle sets: words of a shingle, thousandths, bits, bands of two min-wise hashes each.
SET_WORDS = 5
SIMILAR = 800
WIDE_RADIUS = 20
BANDS = 12
#: Sets and their shingles that are verified in one group (twice as many, as a pair of parts).
VERIFIED_SETS, VERIFIED_SHINGLES = 512, 500_000
#: Parts in which the edges of one node are dealt out.
SALTS = 64
#: Ids that are broadcast at most, behind a count.
BROADCAST_IDS = 1_000_000


def shingle_hashes(raw: bytes, words_n: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, A-Z lower-cased, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < words_n:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words_n - 1 :], strict=False)), np.uint64, len(words) - words_n + 1)


def fingerprint(raw: bytes, words_n: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no word: zero."""
    return fingerprint_of(shingle_hashes(raw, words_n))


def fingerprint_of(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        piece = hashes[k : k + CHUNK]
        counts += np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a long, the 64 bits as signed) of every row; a null text has no word."""
    session_of(docs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(compute, "doc_id long, fp long")


def parts_for(distinct: int, radius: int) -> int:
    """The smallest number of parts by which a key of evenly spread fingerprints holds a group at most."""
    m = radius + 1
    while m < 2 * radius and distinct / 2.0 ** (BITS * (m - radius) / m) > GROUP:
        m += 1
    return m


def part_masks(m: int, radius: int) -> list[int]:
    edges = [BITS * k // m for k in range(m + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def tile_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all rows of one group within the radius. Rows are in order of group and population count."""
    counts = np.bitwise_count(fps).astype(np.int64)
    n = len(fps)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, TILE):
        end = min(a + TILE, n)
        for b in range(a, n, TILE):
            if b > a and (group[b] != group[end - 1] or counts[b] - counts[end - 1] > radius):
                break  # in order: no later tile shares a group, or is nearer
            near = np.bitwise_count(fps[a:end, None] ^ fps[None, b : b + TILE]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            own = (i < j) & (group[i] == group[j])
            left.append(i[own])
            right.append(j[own])
    return np.concatenate(left), np.concatenate(right)


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links (a, b) of nodes: each linked node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    u, v = star(a, b)
    keep = u != v
    return pa.RecordBatch.from_arrays([pa.array(u[keep], pa.int64()), pa.array(v[keep], pa.int64())], ["u", "v"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their first column, cut so that no value of it lies in two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(first == first[-1], True))  # the last group may go on
        if held and (cut or held[-1].column(0)[-1].as_py() != first[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [b.slice(cut)]
        elif cut:
            yield b.slice(0, cut)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def compare_groups(radius: int):
    """For rows (group, node, fp) in order of group and population count: edges between linked nodes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            node = b.column(1).to_numpy()
            i, j = tile_links(b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64), radius)
            yield edge_batch(node[i], node[j])

    return compare


def keyed_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join every two nodes that share a key and whose fingerprints are within the radius, maybe by way of others. keyed: key, node, fp."""
    spark = session_of(keyed)
    rows = keyed.withColumn("ones", F.bit_count("fp"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key", F.lit(True).alias("large"))
    marked = rows.join(large, "key", "left")
    plain = marked.where("large is null").select(F.col("key").alias("group"), "node", "fp", "ones")
    # large keys: places in order of population counts, as if equal counts were shuffled; a range of GROUP places is a part
    cells = marked.where("large is not null").groupBy("key", "ones").agg(F.count("*").alias("held"))
    run = Window.partitionBy("key").orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)  # 65 rows a key at most
    cells = settle(cells.withColumn("before", F.coalesce(F.sum("held").over(run), F.lit(0))), "cells")
    spans = cells.select("key", "ones", F.explode(F.expr(f"sequence(before div {GROUP}, (before + held - 1) div {GROUP})")).alias("part"))
    spans = spans.groupBy("key", "part").agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    one, two = spans.select("key", "part", "low", "high"), spans.select("key", F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = one.join(two, "key").where((F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius))
    pairs = near.select("key", "part", F.xxhash64("key", F.least("part", "part2"), F.greatest("part", "part2")).alias("group"))
    placed = marked.where("large is not null").join(cells, ["key", "ones"])
    placed = placed.withColumn("part", F.expr(f"(before + pmod(xxhash64(node), held)) div {GROUP}"))
    paired = placed.join(pairs, ["key", "part"]).select("group", "node", "fp", "ones")
    dealt = plain.unionByName(paired).repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group", "ones")
    return dealt.select("group", "node", "fp").mapInArrow(compare_groups(radius), "u long, v long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that join every two distinct fingerprints (column fp) within the radius, maybe by way of others."""
    masks = part_masks(parts_for(distinct.count(), radius), radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    return keyed_links(distinct.select(F.explode(keys).alias("key"), F.col("fp").alias("node"), "fp"), radius)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least v of each u as m. The edges of a node of very many meet it in SALTS parts."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node that has an edge (u, v).

    Alternates large-star and small-star steps until the edges stay the same;
    each step's edges are written to the shared folder, so its lineage is short.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def seen(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = seen(edges)
    while mark[0]:
        both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = settle(small.where("u <> v").distinct(), "edges")
        before, mark = mark, seen(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. component_id is the smallest doc_id that links reach, itself
    included; null ids never name a component, and one of null ids alone has a
    null component_id. Repeated rows and equal texts share a fingerprint and
    hence a component. No rows give no rows.
    """
    rows = settle(fingerprints(docs), "fingerprints")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(fingerprint_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# similarity of shingle sets


def shingle_set(raw: bytes | None, words_n: int = SET_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, none give none."""
    return np.unique(shingle_hashes(raw or b"", words_n))


def set_number(own: np.ndarray) -> int:
    """One number for equal sets."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.astype("<u8").tobytes(), 7) - (1 << 63)


def band_keys(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a set: each joins the smallest values of two multiplicative orders of its hashes.

    Two sets of similarity t share a band with a chance of t * t each: of all
    pairs at 0.8, 0.36^12 (five in a million) share none.
    """
    odd = (np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mixed = own ^ (own >> np.uint64(31))
    least = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(mixed), CHUNK):
        least = np.minimum(least, (mixed[None, k : k + CHUNK] * odd[:, None]).min(1))
    one, two = least[::2], least[1::2]
    joined = (one ^ (two >> np.uint64(29)) ^ np.arange(BANDS, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + two * np.uint64(0x165667B19E3779F9)
    return (joined ^ (joined >> np.uint64(32))).view(np.int64)


def set_rows(docs: DataFrame, words_n: int) -> DataFrame:
    """doc_id, text_hash, node (the number of its shingle set), n (shingles), fp (of the set) and bands of every row."""
    session_of(docs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps, bands = [], [], [], []
            for t in b.column(1):
                own = shingle_set(t.as_py(), words_n)
                nodes.append(set_number(own))
                sizes.append(len(own))
                fps.append(fingerprint_of(own))
                bands.append(band_keys(own) if len(own) else np.zeros(0, np.int64))
            columns = [b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(compute, "doc_id long, text_hash long, node long, n long, fp long, bands array<long>")


def similar_pairs(sets: list[np.ndarray], similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the sets (sorted) with a similarity of at least so many thousandths."""
    sizes = np.array([len(s) for s in sets], np.int64)
    near = np.triu(np.minimum(sizes[:, None], sizes[None, :]) * 1000 >= np.maximum(sizes[:, None], sizes[None, :]) * similar, 1)
    i, j = np.nonzero(near)
    if len(sets) <= 8:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        # members of each shingle that two or more have, as columns of a matrix; its product counts what is shared
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        again = held[column] > 1
        number = np.cumsum(held > 1) - 1
        row, column = row[again], number[column[again]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1.0
            shared += part @ part.T
        both = shared[i, j].astype(np.int64)  # whole numbers below 2^24 are exact
    good = both * 1000 >= (sizes[i] + sizes[j] - both) * similar
    return i[good], j[good]


def verified_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, words_n: int, similar: int) -> DataFrame:
    """Edges that join every two similar sets among those that candidate edges join, maybe by way of others. classes: node, n, text_hash.

    The sets of a candidate component are parts of bounded size; each pair of
    parts is a group, to which a set is sent once.
    """
    spark = session_of(docs)
    members = settle(components(candidates).join(classes.select("node", "n", "text_hash"), "node"), "candidates")
    sizes = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    parts = sizes.select("root", F.greatest(F.ceil(F.col("sets") / VERIFIED_SETS), F.ceil(F.col("shingles") / VERIFIED_SHINGLES)).alias("parts"))
    asked = members.select("text_hash").distinct()
    texts = docs.select(F.col("text").cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(bounded(settle(asked, "asked"), BROADCAST_IDS), "text_hash", "left_semi")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), words_n).tobytes() for t in b.column(1)], pa.binary())], ["text_hash", "own"])

    known = texts.select("text_hash", "text").mapInArrow(compute, "text_hash long, own binary").groupBy("text_hash").agg(F.first("own").alias("own"))  # equal hash, equal text
    dealt = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.join(known, "text_hash").select("root", "part", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    # with more than one part, a part meets itself beside each other one
    dealt = dealt.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("group"), "node", "own")
    grouped = dealt.repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000))
        for b in whole_groups(small):
            group, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, e in zip(firsts, [*firsts[1:], len(group)], strict=True):
                i, j = similar_pairs([np.frombuffer(x.as_py(), np.uint64) for x in b.column(2).slice(a, e - a)], similar)
                left.append(node[a + i])
                right.append(node[a + j])
            yield edge_batch(np.concatenate(left), np.concatenate(right))

    return grouped.mapInArrow(compare, "u long, v long")


def similar_components(docs: DataFrame, words_n: int = SET_WORDS, similar: int = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, text_hash, root (a number of its component) and component_id of every row of docs: texts whose shingle sets are similar, and chains of them.

    Links have a similarity (shared of all shingles) of at least ``similar``
    thousandths, verified on the whole sets. Candidates share a band and are
    within the radius; at a similarity of 0.8 fingerprints of 64 bits differ in
    9.7 bits on average, with a deviation of 2.9. Texts without a word are one
    set; equal sets are linked. component_id is as in near_duplicates.
    """
    rows = settle(set_rows(docs, words_n), "shingle-sets")
    # rows of one set agree in n, fp and bands
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    classes = settle(classes, "classes")
    candidates = settle(keyed_links(classes.select(F.explode("bands").alias("key"), "node", "fp"), radius), "candidate-edges")
    roots = components(verified_links(docs, classes, candidates, words_n, similar))
    rooted = classes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(named, "root").select("node", "root", "component_id")
    return rows.join(found, "node").select("doc_id", "text_hash", "root", "component_id")


# one of each


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_of_each(docs: DataFrame, by: Column) -> DataFrame:
    """The first row by text of each value of by, an expression of the columns."""
    record = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), by.alias("by"))
    nth = Window.partitionBy("by").orderBy(F.col("record.text").asc_nulls_first())
    return record.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select("record.*")


def keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names a component of found (doc_id, text_hash, root, component_id), with all columns.

    Texts stay where they are: the ids that go are a narrow table, broadcast up
    to BROADCAST_IDS. Of rows that repeat a kept doc_id, the first by text stays.
    Rows of null id stay only where their whole component has no id: the first
    by text of each.
    """
    found = settle(found, "components")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    odd = settle(ids.where("not kept or times > 1").select(F.col("doc_id").alias("odd id"), (F.col("kept") & (F.col("times") > 1)).alias("again")), "odd-ids")
    doc_id = docs["doc_id"].cast("long")
    known = docs.where(F.col("doc_id").isNotNull())
    others = bounded(odd.select("odd id"), BROADCAST_IDS)
    kept = known.join(others, doc_id == others["odd id"], "left_anti")
    again = odd.where("again").select("odd id")
    if again.take(1):
        again = bounded(again, BROADCAST_IDS)
        kept = kept.unionByName(first_of_each(known.join(again, doc_id == again["odd id"], "left_semi"), F.col("doc_id")))
    lone = found.where("doc_id is null and component_id is null").select(F.col("text_hash").alias("lone hash"), F.col("root").alias("lone root")).distinct()
    if lone.take(1):
        nameless = docs.where(F.col("doc_id").isNull())
        rows = nameless.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.xxhash64(F.col("text").cast("binary")).alias("its hash")).join(lone, F.col("its hash") == F.col("lone hash"))
        nth = Window.partitionBy("lone root").orderBy(F.col("record.text").asc_nulls_first())
        kept = kept.unionByName(rows.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select("record.*"))
    return kept


def keep_one_of_similar(docs: DataFrame, words_n: int = SET_WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row of each component of similar shingle sets, as keep_named says."""
    return keep_named(docs, similar_components(docs, words_n, similar))
