"""The registered queries and the pipeline over the smallest given tables."""

import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from pathlight.llm.common import table
from pathlight.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, canonical

from .conftest import records
from .test_decontamination import slow as slow_contamination
from .test_simhash import slow_components, slow_fingerprint

FOLDER = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_quality": "doc_id quality_score quality_pred",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_url_filter": "page_id host path rule verdict",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_lexical_search": "item_id rank doc_id score",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    rows = [tuple(row) for row in frame.collect()]
    source = "pages" if name in ("op8_warc", "op11_url_filter") else "documents"
    assert name in ("op12_collocations", "op13_lexical_search") or len(rows) == duck.execute(f"SELECT count(*) FROM {source}").fetchone()[0]
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [column[0] for column in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert canonical(rows, frame.columns) == canonical(result.fetchall(), columns)


def test_fingerprints_and_components_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in records(table(spark, FOLDER, "documents"))}
    prints = {doc: slow_fingerprint(text) for doc, text in docs.items()}
    least = {}
    for doc, root in ((d, slow_components(set(prints.values()), 4)[p]) for d, p in sorted(prints.items())):
        least.setdefault(root, doc)
    roots = slow_components(set(prints.values()), 4)
    for r in records(QUERIES["op7_simhash"](spark, FOLDER)):
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == least[roots[prints[r["doc_id"]]]]


def test_stages_of_the_pipeline_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.staged(stage(spark, kept[-1], FOLDER), "stage"))
        assert kept[-1] is kept[-1] and (len(kept) > len(corpus_pipeline.STAGES) or kept[-1].columns == columns)
    rows = [{r["doc_id"]: r for r in records(frame)} for frame in kept]
    start, told, unique, clean = rows[:4]
    assert set(told) == {i for i, r in start.items() if any(c.isalpha() for c in r["text"])}
    prints = {i: slow_fingerprint(r["text"]) for i, r in told.items()}
    roots = slow_components(set(prints.values()), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert set(unique) == set(least.values())
    items = [(r["item_id"], r["text"]) for r in records(table(spark, FOLDER, "benchmark"))]
    assert set(clean) == {i for i, r in unique.items() if not slow_contamination(r["text"], items)[3]}
    copies = Counter(r["doc_id"] for r in records(kept[4]))
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    assert all(kept_row == clean[kept_row["doc_id"]] for kept_row in records(kept[4]))
    final = records(kept[5])
    assert Counter(r["doc_id"] for r in final) == copies
    slots = Counter(r["shard"] for r in final)
    assert {(r["shard"], r["slot"]) for r in final} == {(s, n) for s, count in slots.items() for n in range(count)}
    assert all(r["text"] == start[r["doc_id"]]["text"] and len({x["shard"] for x in final if x["doc_id"] == r["doc_id"]}) == 1 for r in final)


def test_run_gives_the_rows_of_the_stages(spark):
    final = records(corpus_pipeline.run(spark, FOLDER))
    assert final and all(0 <= r["shard"] < 16 for r in final)


def test_learning_skips_what_is_held_out(spark):
    rows = records(QUERIES["op5_language_id"](spark, FOLDER))
    truth = {r["doc_id"]: r["lang"] for r in records(table(spark, FOLDER, "documents"))}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_only_the_entry_point_may_lack_the_operators():
    root = os.path.dirname(driver.__file__)
    for folder, _, names in os.walk(os.path.join(root, "pathlight")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, name)).read()), name
