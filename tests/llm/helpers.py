"""Small tables with every hard case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "et", "or", "da"]) for _ in range(rng.randint(1, 3)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, exact and near copies, repeated rows and ids."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randint(1, 80)), rng.choice(["en", "fr"]), f"src{k % 5}", None) for k in range(40)]
    long = prose(rng, 6000)
    copy = rows[3][1]
    near = prose(rng, 400)
    rows += [
        (40, None, "en", "src0", 0),
        (41, "", None, "src0", 0),
        (42, " \t\n ", "fr", None, 3),
        (43, "12 34 -- !!", "en", "web", None),
        (44, long, "en", "src1", len(long)),
        (45, copy, "en", "src1", None),
        (46, copy, "fr", None, None),
        (47, near, "en", "src2", None),
        (48, near + " end", "en", "src2", None),
        (49, "É ß Ünïcode ΑΣ 你好 <|endoftext|> x", None, "src9", None),
        (None, copy, "en", "src1", None),
        (None, "nameless text of its own here", "en", "src1", None),
        (3, copy, "en", "src3", None),
        (3, "another text under a known id", "en", "src3", None),
    ]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        clashing = "shard size slot law range cell key fingerprint component_id fp u v node domain copies tokens rows budget rest draw hash_range word n score start n_tokens lang_pred item_id license h path host low text_hash record by nth times kept odd again root its group part other own bands its_language nth_kept mix_copies shard_no slot_no".split()
        df = df.withColumns({c: F.lit("clash") for c in clashing})
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
