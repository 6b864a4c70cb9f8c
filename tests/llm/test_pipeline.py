"""Each stage against a plain version of it, on what the stage before kept."""

from __future__ import annotations

import os
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from skyloom.llm.simhash import similar_components

from .helpers import documents, frame, prose
from .test_decontaminate import plain as leaks
from .test_mixing import plain as mixed
from .test_token_store import expected_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(11)
    items = [(k, prose(rng, 25)) for k in range(4)]
    docs = documents(3) + [(500 + k, f"{prose(rng, 40)}\n{items[k % 4][1]}\n{prose(rng, 30)}", "en", "src1", None) for k in range(6)]
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def plain_rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages(spark, tables):
    folder, docs, items = tables
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_duplicates", "decontamination", "mixing", "token_store"]
    first = steps["language_id"](spark, frame(spark, docs), folder)
    assert first.columns == COLUMNS
    kept = plain_rows(first)
    assert {r[0] for r in docs} - {r[0] for r in kept} >= {40, 41, 42, 43}
    assert sorted(kept, key=repr) == sorted((r for r in docs if r[1] and any(map(str.isalpha, r[1])) and r in kept), key=repr)

    second = steps["near_duplicates"](spark, frame(spark, kept), folder)
    names = {r.component_id for r in similar_components(frame(spark, kept)).collect() if r.component_id is not None}
    once = plain_rows(second)
    assert sorted(r[0] for r in once if r[0] is not None) == sorted(names)

    third = steps["decontamination"](spark, frame(spark, once), folder)
    bad = {r[0] for r in leaks(once, items)}
    clean = plain_rows(third)
    assert bad and sorted(clean, key=repr) == sorted((r for r in once if r[0] not in bad), key=repr)

    fourth = steps["mixing"](spark, frame(spark, clean), folder)
    assert fourth.columns == COLUMNS
    used = plain_rows(fourth)
    expected = [r[0] for r in mixed(clean) for _ in range(r[5])]
    assert sorted((r[0] for r in used), key=repr) == sorted(expected, key=repr)

    last = steps["token_store"](spark, frame(spark, used), folder)
    assert sorted((tuple(r) for r in last.collect()), key=lambda r: r[1]) == expected_rows(used)


def test_run(spark, tables):
    folder, _, _ = tables
    whole = corpus_pipeline.run(spark, folder).collect()
    assert whole and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(whole[0].asDict())


def test_empty_documents(spark, tables, tmp_path):
    folder, _, items = tables
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_decontamination", "op5_mixing"])
def test_sql_of_the_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from skyloom.llm.queries import ORACLE_SQL, QUERIES

    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    result = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, ([r[c] for c in names] for r in found.collect()))) == sorted(map(repr, map(list, result.fetchall())))
