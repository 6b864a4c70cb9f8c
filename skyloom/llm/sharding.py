"""Sharding by sampled splitters: near-equal shards of bytes over a range-partitioned key.

The key of a record is (xxhash64 of its text, doc_id), so equal texts lie side
by side and most of them in one shard. A size-weighted sample of keys gives
splitters, the splitters give narrow ranges, and the exact bytes of each range
say where its rows lie among all bytes. Ranges that came out overfull (a text
that many documents share) are subdivided by doc_id. A row's shard follows from
the exact place of its middle byte: shards differ by less than one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, settle

#: Ranges for each shard, and sampled keys for each range (documented bounds of what the driver gets).
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 64
#: Rows of the size-weighted sample are drawn by this seed.
SEED = 7
MAX_RANGES = 1 << 16


def sized_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null: that of no bytes, 0) and key."""
    return docs.select(*[sized_column(k).alias(k) for k in ("doc_id", "size", "text_crc32", "key")])


def sized_column(name: str) -> Column:
    text = F.col("text").cast("string")
    return {
        "doc_id": F.col("doc_id").cast("long"),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
        "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
        "key": F.xxhash64(text),
    }[name]


def splitters(keyed: DataFrame, ranges: int, rows: int, total: int) -> np.ndarray:
    """Quantile boundaries of a size-weighted sample: a row is drawn with a chance in proportion to its bytes."""
    wanted = ranges * SAMPLES_PER_RANGE
    rate = wanted / max(1, total)
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    # a row of more bytes than one sample stands for weighs more; the draw depends on the row alone
    draw = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance
    sample = keyed.where(draw).select("key", F.greatest(F.lit(1.0), F.col("size") * F.lit(rate)).alias("weight"))
    got = sample.toArrow()  # about wanted rows at most, by the rate
    keys, weights = got["key"].to_numpy(), got["weight"].to_numpy()
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, mass = keys[order], np.cumsum(weights[order])
    at = np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    Law ``bytes``: all shards hold near-equal sizes. Slots count a shard's rows
    in key order from 0 without gaps. grown_shard is null: this law has no such
    promise. Null texts have size 8 and share a key; null doc ids come first
    within a key; repeated rows each get their own slot. An empty table gives no
    rows. Other columns of docs are not read, so their names cannot clash.
    """
    spark = session_of(docs)
    # narrow rows, kept once in the shared folder: the sample, the range sums and the places all read them
    keyed = settle(sized_keys(docs), "keys")
    rows, total = keyed.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = int(min(MAX_RANGES, max(shards * RANGES_PER_SHARD, rows // 50_000)))
    cuts = spark.sparkContext.broadcast(splitters(keyed, ranges, rows, total))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(cuts.value, b.column("key").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "range"])

    ranged = keyed.mapInArrow(locate, "doc_id long, size long, text_crc32 long, key long, range long")
    # the exact load of each range; an overfull one is dealt out again into parts by doc_id
    load = ranged.groupBy("range").agg(F.sum("size").alias("load"))
    fair = max(1.0, total / max(1, ranges))
    parts = load.select("range", F.ceil(F.col("load") / F.lit(2 * fair)).cast("long").alias("parts"))
    over = {r["range"]: r["parts"] for r in parts.where("parts > 1").collect()}  # at most as many as ranges
    cell = F.col("range") * F.lit(1 << 20)
    if over:
        subdivided = spark.createDataFrame(list(over.items()), "range long, parts long")
        step = F.pmod(F.xxhash64("doc_id"), F.coalesce(F.col("parts"), F.lit(1)))
        ranged = ranged.join(F.broadcast(subdivided), "range", "left")
        cell = cell + F.when(F.col("parts").isNull(), 0).otherwise(step)
    ranged = ranged.withColumn("cell", cell)
    # cells lie in order: the bytes and rows before each are sums over at most MAX_RANGES rows and their parts
    sums = ranged.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    got = sums.toArrow().sort_by("cell")
    sizes, counts = got["bytes"].to_numpy(), got["n"].to_numpy()
    before = pa.table({"cell": got["cell"], "bytes_before": np.cumsum(sizes) - sizes, "rows_before": np.cumsum(counts) - counts})
    if before.num_rows == 0:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    bases = F.broadcast(spark.createDataFrame(before))
    inside = Window.partitionBy("cell").orderBy(F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"))
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(bases, "cell").select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(run) - F.col("size")).alias("first_byte"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    # 2 * middle byte, in whole numbers, so that nothing is rounded
    shard = F.expr(f"((2 * first_byte + size) * {shards}) div {2 * total}")
    placed = settle(placed.select("doc_id", "size", "text_crc32", "place", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard")), "places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes whole records of docs to a folder for each shard (``shard_no``), in slot order.

    Rows that agree in doc_id, size and checksum are interchangeable for the
    law; they are matched with their places by count.
    """
    keys = ["doc_id", "text_crc32", "size"]
    sized = docs.select(F.struct(*docs.columns).alias("record"), "doc_id", "text").select("record", *[sized_column(k).alias(k) for k in keys])
    own = sized.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    places = assign_shards(docs, shards).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot")))
    same = own["doc_id"].eqNullSafe(places["doc_id"]) & (own["nth"] == places["nth"]) & (own["text_crc32"] == places["text_crc32"]) & (own["size"] == places["size"])
    out = own.join(places, same).select("record.*", F.col("shard").alias("shard_no"), F.col("slot").alias("slot_no"))
    out.repartition(shards, "shard_no").sortWithinPartitions("shard_no", "slot_no").write.partitionBy("shard_no").parquet(path)
