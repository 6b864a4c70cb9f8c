"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

* language_id drops texts without a letter and those in no learned language;
* near_duplicates keeps of texts that share 0.8 of their five-word shingles (and chains of them) the one of the smallest id, found by SimHash;
* decontamination drops documents that contain a benchmark item;
* mixing repeats or drops documents so that sources meet their weights;
* token_store writes the ids of what is left and returns a row for each document of the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import settle, table
from skyloom.llm.decontaminate import decontaminate
from skyloom.llm.langid import keep_identified
from skyloom.llm.mixing import mix
from skyloom.llm.simhash import keep_one_of_similar
from skyloom.llm.token_store import read_token_store, write_token_store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; a null lang teaches nothing; repeated rows share their fate; no rows give no rows."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash tiles give candidates, whole five-word shingle sets of a similarity of 0.8 or more are links.

    Texts without a word are equal. Of a repeated doc_id the first row by text
    stays, if it is the id that stays; rows without an id only where their whole
    group has none, the first by text.
    """
    return keep_one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts contain nothing and stay, as all do if the benchmark is empty; rows of one doc_id share their fate, those without an id are one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null lang and source are leaves of their own; texts without a token cost nothing; equal ids of a leaf are taken together."""
    return mix(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs; null texts are the end id alone, null ids come first, repeated ones lie side by side."""
    import public_tokenizers

    return read_token_store(spark, write_token_store(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_store", token_store),
]

#: Fingerprints, language models and token ids have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
