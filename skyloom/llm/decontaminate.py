"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification, in DataFrame functions only.

An item of n distinct shingles counts as contained in a text that has at least
need = ceil(threshold * n) of them. Its sketch is its n - need + 1 smallest
shingle hashes (a bottom-k MinHash): a text that lacks all of them lacks more
than n - need shingles, so every contained item shares a sketch hash with the
text, however long the text is. Items are partitioned by size (powers of two);
a text only meets partitions whose items it is long enough to contain. Pairs
found so are verified on the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

WORDS = 5
THRESHOLD = 0.8
#: A sketch index or item table of more rows is joined by shuffling, not broadcast (about 30 bytes a row).
BROADCAST_ROWS = 1_000_000
#: Pairs to verify whose ids are broadcast at most; more make the texts move once.
BROADCAST_PAIRS = 200_000
WORD_BREAK = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    """Words of letters and digits, lower-cased; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), lambda w: w != "")


def shingles_of(words: Column, width: Column) -> Column:
    """Distinct shingles of a width, space-joined; fewer words give none."""
    places = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.slice(words, i, width))))


def shingle_hash(hashes: str, place: str, width: int) -> Column:
    """Hash of a shingle from its words' hashes; equal shingles have equal hashes at any place."""
    return F.xxhash64(*[F.get(F.col(hashes), F.col(place) + k) for k in range(width)])


def item_shingles(items: DataFrame, words_n: int, threshold: float) -> DataFrame:
    """item_no, item_id, width (words_n, or all words of a shorter item), words, shingles, n, need and size_class of items that have a word.

    item_no stands for an id and a text, so that an item without an id is one too.
    """
    once = items.select("item_id", "text").distinct()
    words = once.select(F.xxhash64("item_id", "text").alias("item_no"), "item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    wide = words.withColumn("width", F.least(F.size("words"), F.lit(words_n)))
    counted = wide.withColumn("shingles", shingles_of(F.col("words"), F.col("width"))).withColumn("n", F.size("shingles"))
    # in whole thousandths: 0.8 * 5 is 4 and not a little more
    need = F.expr(f"cast((n * {round(threshold * 1000)} + 999) div 1000 as int)")
    return counted.withColumn("need", F.greatest(need, F.lit(1))).withColumn("size_class", F.floor(F.log2("n")).cast("int"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, words_n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment for every text and item with containment of at least the threshold.

    Null and empty texts contain nothing and items without a word are contained
    in nothing; items of fewer words than a shingle are one shingle of all their
    words; an item without an id is returned with a null item_id. Rows that repeat a doc_id with another text are searched apart, and
    the best containment of the id is returned; equal rows are one. Null ids are
    returned as null.
    """
    known = settle(item_shingles(items, words_n, threshold), "items")
    sizes = known.groupBy("width").agg(F.count("*").alias("items"), F.sum("n").alias("shingles")).collect()  # words_n rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("word_hashes"))
    hits = []
    for row in sizes:
        width = row["width"]
        own = known.where(F.col("width") == width).select("item_no", "size_class", "n", "need", F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
        places = own.select("*", F.explode(F.sequence(F.lit(0), F.size("word_hashes") - width)).alias("place"))
        ranked = places.select("item_no", "size_class", "n", "need", shingle_hash("word_hashes", "place", width).alias("h")).distinct()
        order = Window.partitionBy("item_no", "n", "need").orderBy("h")
        # least_n: what the smallest item of the size class needs, so the fewest shingles a text must have to meet it
        least = F.ceil(F.pow(F.lit(2.0), "size_class") * F.lit(threshold)).cast("int")
        sketch = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - F.col("need") + 1).select("h", "item_no", least.alias("least_n"))
        long_enough = hashed.where(F.size("word_hashes") >= width)
        probes = long_enough.select("doc_id", "text_hash", "word_hashes", F.explode(F.sequence(F.lit(0), F.size("word_hashes") - width)).alias("place"))
        probes = probes.select("doc_id", "text_hash", (F.size("word_hashes") - width + 1).alias("text_n"), shingle_hash("word_hashes", "place", width).alias("h"))
        met = probes.join(_bounded(sketch, row["shingles"]), "h").where("text_n >= least_n")
        hits.append(met.select("doc_id", "text_hash", "item_no").distinct())
    if not hits:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_shingles int, shared int, containment double")
    pairs = hits[0]
    for more in hits[1:]:
        pairs = pairs.unionByName(more)
    pairs = settle(pairs, "pairs")
    return verified(texts, known, sum(r["items"] for r in sizes), pairs, threshold)


def verified(texts: DataFrame, known: DataFrame, items: int, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose text has enough of the item's shingles, compared as strings."""
    found = pairs.groupBy("doc_id", "text_hash").agg(F.collect_set("item_no").alias("item_nos"))  # at most the items that share a hash with one text
    if pairs.count() <= BROADCAST_PAIRS:
        found = F.broadcast(found)
    named = texts.withColumn("text_hash", F.xxhash64("text"))
    same = named["doc_id"].eqNullSafe(found["doc_id"]) & (named["text_hash"] == found["text_hash"])
    met = named.join(found, same).select(named["doc_id"], words_of(F.col("text")).alias("text_words"), F.explode("item_nos").alias("item_no"))
    both = met.join(_bounded(known.select("item_no", "item_id", "width", "shingles", "n", "need"), items), "item_no")
    shared = F.size(F.array_intersect("shingles", shingles_of(F.col("text_words"), F.col("width"))))
    kept = both.select("doc_id", "item_id", F.col("n").alias("item_shingles"), shared.alias("shared"), "need").where(F.col("shared") >= F.col("need"))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "item_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_shingles", "best.shared", (F.col("best.shared") / F.col("best.item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, words_n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id contains no item; rows of null id go if any of them contains one."""
    leaks = settle(contained_items(docs, items, words_n, threshold).select(F.col("doc_id").alias("leaking_id")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leaking_id"]), "left_anti")


#: The same, plainly, in DuckDB: all shingles of all texts against all shingles of all items.
ORACLE = f"""
with iw as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') w from benchmark),
ig as (select distinct item_id, least(len(w), {WORDS}) k, array_to_string(w[i : i + least(len(w), {WORDS}) - 1], ' ') s
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WORDS}) + 2)) i from iw where len(w) > 0)),
isz as (select item_id, count(*) n from ig group by 1),
dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') w from documents),
dg as (select distinct doc_id, k, array_to_string(w[i : i + k - 1], ' ') s
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, (select distinct k from ig) where len(w) >= k)),
hit as (select doc_id, item_id, count(*) shared from dg join ig using (k, s) group by all)
select doc_id, item_id, n::int item_shingles, shared::int shared, shared / n containment
from hit join isz using (item_id) where shared >= greatest(1, (n * {round(THRESHOLD * 1000)} + 999) // 1000)
"""

assert math.isclose(round(THRESHOLD * 1000) / 1000, THRESHOLD)
