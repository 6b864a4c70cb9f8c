"""Approximate nearest neighbours by largest inner product: a permutation index in pivot inverted files.

Each vector is represented by its nearest pivots in order. The largest inner
product becomes nearness by one more component, sqrt(M^2 - |x|^2) for stored
vectors and 0 for queries, M the largest norm. Of n vectors, sqrt(n) pivots (128
at least) are chosen. A vector's id and the order of its first PREFIX pivots are posted in the
inverted files of its first POSTED pivots; a query visits the files of its own
first n^(1/4) pivots (20 at least), and looks at a posting in the first of its files that holds
it only: 8 * n^(3/4) postings at most, where vectors spread evenly.

Postings are ranked by Spearman's footrule to the query's order. Those within the
query's own distance are reranked: it is the quantile of the distances to a
sample that lets about RERANKED * sqrt(n) of all vectors through. Only their ids
travel: blocks of vectors and queries meet their pairs, and the inner product of
the original vectors in double precision decides.

Files are dealt out as blocks of bounded size (a share of the postings against a
share of the queries), so a file that a third of all vectors are posted in is
many groups. Queries that found fewer than k, though more vectors exist, are
compared with all vectors in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, settle

LEAST_PIVOTS, MOST_PIVOTS = 128, 16_384
#: Rows among which pivots are chosen and distances are measured (a bounded sample, those of the smallest hashes): this many times as many as pivots, within bounds. Two pivots above SAME are one.
SAMPLED, LEAST_SAMPLE, MOST_SAMPLE = 8, 2048, 65_536
SAME = 0.9
PREFIX = 128
POSTED = 8
LEAST_VISITED = 20
#: Reranked vectors of a query, in square roots of the number of vectors; at least LEAST_RERANKED.
RERANKED, LEAST_RERANKED = 10, 500
BLOCK, QUERY_BLOCK = 4096, 512


def pivots_for(n: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, round(sqrt(n))))


def visited_for(n: int) -> int:
    return max(LEAST_VISITED, ceil(n**0.25))


def reranked_for(n: int) -> int:
    return max(LEAST_RERANKED, ceil(RERANKED * sqrt(n)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) and norm of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.withColumn("norm", norm).where(F.col("norm") > 0)


def choose_pivots(lifted: np.ndarray, wanted: int) -> np.ndarray:
    """So many directions at most of a sample, with those near a chosen one last."""
    chosen: list[int] = []
    later: list[int] = []
    for i in range(len(lifted)):
        near = len(chosen) and float((lifted[chosen] @ lifted[i]).max()) > SAME
        (later if near else chosen).append(i)
        if len(chosen) == wanted:
            break
    return lifted[(chosen + later)[:wanted]]


def lift(vectors: np.ndarray, most: float) -> np.ndarray:
    scaled = vectors / most
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def nearest_pivots(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each row's first PREFIX pivots, nearest first."""
    return np.argsort(-(lifted @ pivots.T), axis=1, kind="stable")[:, : min(PREFIX, len(pivots))].astype(np.int16)


def places_of(orders: np.ndarray, pivots_n: int) -> np.ndarray:
    """For each pivot (row) its place in each stored order, the prefix length where it's missing."""
    n, prefix = orders.shape
    places = np.full((pivots_n, n), prefix, np.int16)
    places[orders.T.astype(np.int64), np.arange(n)] = np.arange(prefix, dtype=np.int16)[:, None]
    return places


def footrule(places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Spearman's footrule of each stored order to a query's, missing pivots counted as placed last, less a constant. places: those of places_of."""
    own = places[order]
    here = np.arange(len(order), dtype=np.int16)[:, None]
    return (np.abs(own - here) + own).sum(0, dtype=np.int32)


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids, by score and then the smaller id; an id's best score stands for it."""
    order = np.lexsort((ids, -scores))
    if len(order) > 1:
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)]
    return order[:k]


def visit_files(pivots_n: int, blocks: int):
    """For blocks of postings and queries of one file: the pairs within the queries' distances, ids packed by the block of their vectors."""

    def search(key, stored: pa.Table, asked: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"block": [], "query_id": [], "ids": []}
        schema = [("block", pa.int32()), ("query_id", pa.int64()), ("ids", pa.binary())]
        if stored.num_rows and asked.num_rows:
            ids, block = stored["vec_id"].to_numpy(), stored["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            ids, block = ids[order], block[order]
            orders = np.frombuffer(b"".join(stored["pivots"].to_pylist()), "<i2").reshape(len(ids), -1)[order]
            places, posted = places_of(orders, pivots_n), orders[:, :POSTED].astype(np.int64)
            file = key[0].as_py()
            for query, raw, visited, most in zip(*(asked[c].to_pylist() for c in ("asked_id", "asked_pivots", "asked_files", "most")), strict=True):
                turn = np.full(pivots_n, len(visited), np.int16)
                turn[visited] = np.arange(len(visited))
                near = (footrule(places, np.frombuffer(raw, "<i2")) <= most) & (turn[posted].min(1) == turn[file]) & (ids != query)
                at = np.flatnonzero(near)
                cuts = np.flatnonzero(np.diff(block[at], prepend=-1))
                for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)][: len(cuts)], strict=True):
                    rows["block"].append(int(block[at[a]]))
                    rows["query_id"].append(query)
                    rows["ids"].append(ids[at[a:e]].astype("<i8").tobytes())
        return pa.table({c: pa.array(rows[c], kind) for c, kind in schema})

    return search


def rerank(k: int):
    """For a block of vectors and the pairs of a share of the queries (rows with ids) with their vectors (rows with vector; ids null: all of the block): the best k of each query."""

    def score(key, stored: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        if not stored.num_rows or not asked.num_rows:
            return empty
        ids = stored["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        vectors = np.frombuffer(b"".join(stored["vector"].to_pylist()), "<f8").reshape(len(ids), -1)[order]
        wanted: dict[int, list[bytes]] = {}
        own: dict[int, list] = {}
        for query, raw, vector, every in zip(*(asked[c].to_pylist() for c in ("query_id", "ids", "asked_vector", "every")), strict=True):
            if vector is not None:
                own.setdefault(query, []).append((np.frombuffer(vector, "<f8"), every))
            else:
                wanted.setdefault(query, []).append(raw)
        queries, found, scores = [], [], []
        for query, vectors_of_it in own.items():
            if query not in wanted and not vectors_of_it[0][1]:
                continue
            some = np.unique(np.frombuffer(b"".join(wanted.get(query, [])), "<i8"))
            for q, every in vectors_of_it:  # an id that is repeated asks with each of its vectors
                if every:
                    at = np.flatnonzero(ids != query)
                else:
                    first, last = np.searchsorted(ids, some, "left"), np.searchsorted(ids, some, "right")
                    at = np.repeat(first, last - first) + (np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first))
                score_ = (vectors[at] * q).sum(1)  # each row summed alone: equal vectors have equal scores anywhere
                if len(at) > k and (last_ := np.partition(score_, len(at) - k)[len(at) - k]) > score_.min() and len(np.unique(ids[at])) == len(at):
                    keep = score_ >= last_
                    at, score_ = at[keep], score_[keep]
                best = best_k(ids[at], score_, k)
                queries += [query] * len(best)
                found.append(ids[at[best]])
                scores.append(score_[best])
        if not queries:
            return empty
        return pa.table([pa.array(queries, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return score


def build_index(vectors: DataFrame, is_query: Column) -> tuple[DataFrame, int, int]:
    """The settled index, the number of pivots and of vectors.

    vec_id, vector (bytes), pivots (bytes, their numbers in order) and files of
    every vector that takes part; asked_pivots, asked_files and most (the
    greatest distance that is reranked) of queries, else null.
    """
    rows = usable(vectors)
    shape = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dims").first()
    schema = "vec_id long, vector binary, pivots binary, files array<int>, asked_pivots binary, asked_files array<int>, most int"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema), 0, 0
    n, dims, greatest = shape["n"], shape["dims"], shape["most"]
    rows = rows.where(F.size("vector") == dims)
    wanted = pivots_for(n)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLED * wanted))).select("vector").toArrow()["vector"]
    lifted = lift(np.asarray(sample.combine_chunks().flatten()).reshape(-1, dims), greatest)
    pivots = choose_pivots(lifted, wanted)
    near = places_of(nearest_pivots(lifted, pivots), len(pivots))
    rank = ceil(len(lifted) * min(1.0, reranked_for(n) / n))
    visited = visited_for(n)
    shared = session_of(vectors).sparkContext.broadcast((pivots, near, greatest))  # of bounded size

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, near, greatest = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                b = batch.slice(start, 4096)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                own = nearest_pivots(lift(flat, greatest), pivots)
                asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                length = np.sqrt((flat * flat).sum(1))
                asked = nearest_pivots(np.concatenate([flat[asks] / length[asks, None], np.zeros((int(asks.sum()), 1))], axis=1), pivots)
                most = [int(np.partition(footrule(near, q), rank - 1)[rank - 1]) if rank < near.shape[1] else 1 << 30 for q in asked]
                slot = np.cumsum(asks) - 1
                only = lambda made: [made(slot[i]) if asks[i] else None for i in range(len(asks))]  # noqa: E731, B023
                columns = [
                    pa.array([x.astype("<f8").tobytes() for x in flat], pa.binary()),
                    pa.array([x.astype("<i2").tobytes() for x in own], pa.binary()),
                    pa.array(list(own[:, :POSTED].astype(np.int32)), pa.list_(pa.int32())),
                    pa.array(only(lambda i: asked[i].astype("<i2").tobytes()), pa.binary()),  # noqa: B023
                    pa.array(only(lambda i: asked[i][:visited].astype(np.int32)), pa.list_(pa.int32())),  # noqa: B023
                    pa.array(only(lambda i: most[i]), pa.int32()),  # noqa: B023
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["vec_id", "vector", "pivots", "files", "asked_pivots", "asked_files", "most"])

    rows = rows.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks"))
    return settle(rows.mapInArrow(order, schema), "orders"), len(pivots), n


def visited_pairs(index: DataFrame, queries: DataFrame, pivots_n: int, blocks: int) -> DataFrame:
    """block, query_id and ids (packed) of the vectors that the queries rerank."""
    posted = index.select(F.explode("files").alias("file"), "vec_id", "pivots")
    asked = queries.select(F.explode("asked_files").alias("file"), F.col("vec_id").alias("asked_id"), "asked_pivots", "asked_files", "most")
    loads = posted.groupBy("file").agg(F.count("*").alias("n")).join(asked.groupBy("file").agg(F.count("*").alias("asked")), "file")
    shares = F.broadcast(loads.select("file", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("query_parts")))  # MOST_PIVOTS rows at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda name, c: F.pmod(F.xxhash64(name), F.col(c)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    stored = posted.join(shares, "file").select("file", one("vec_id", "parts").alias("part"), every("query_parts").alias("query_part"), "vec_id", "pivots", block)
    sent = asked.join(shares, "file").select("file", every("parts").alias("part"), one("asked_id", "query_parts").alias("query_part"), "asked_id", "asked_pivots", "asked_files", "most")
    keys = ["file", "part", "query_part"]
    return stored.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(visit_files(pivots_n, blocks), "block int, query_id long, ids binary")


def best_of_blocks(index: DataFrame, queries: DataFrame, pairs: DataFrame | None, blocks: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each block for its queries, among their pairs, or among all vectors."""
    shares = max(1, ceil(queries.count() / BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int").alias("share")
    stored = index.select(block, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share("vec_id"), F.col("vec_id").alias("query_id"), F.lit(None).cast("binary").alias("ids"), F.col("vector").alias("asked_vector"), F.lit(pairs is None).alias("every"))
    if pairs is not None:
        asked = asked.unionByName(pairs.select("block", share("query_id"), "query_id", "ids", F.lit(None).cast("binary").alias("asked_vector"), F.lit(False).alias("every")))
    keys = ["block", "share"]
    return stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each row of vectors for which is_query (of vec_id) holds.

    Vectors that are null, zero, hold null or non-finite components, have a null
    vec_id, or another number of components than most, take no part. Equal scores
    go to the smaller vec_id. Rows that repeat a vec_id are one candidate, with
    the best of their scores, and never candidates of their own id. If fewer
    than k candidates exist, all are returned; no rows give no rows.
    """
    index, pivots_n, n = build_index(vectors, is_query)
    queries, blocks = index.where("asked_pivots is not null"), max(1, ceil(n / BLOCK))
    pairs = visited_pairs(index, queries, pivots_n, blocks)
    found = settle(best_of_blocks(index, queries, pairs, blocks, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    # those with fewer than k, though there are more vectors, meet all of them
    total = index.select("vec_id").distinct().limit(k + 1).count()
    complete = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = settle(queries.join(complete, "vec_id", "left_anti"), "short")
    if total > 1 and short.take(1):
        rest = best_of_blocks(index, short, None, blocks, k)
        found = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
