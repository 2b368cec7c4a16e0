"""Registered queries beside their SQL, and the rest's shapes, on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sluice.llm.oracles import ORACLES
from sluice.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
COLUMNS = {
    "op2": "doc_id size source_size target taken", "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "page_id url text n_chars", "op10": "doc_id class_id",
    "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12": "doc_id held_out score predicted",
    "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256"}
TABLE = {"op8": "conversations", "op9": "pages", "op11": "conversations", "op13": "embeddings"}


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    rows = frame.collect()
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(frame.columns)
    table = TABLE.get(name.split("_")[0], "documents")
    if table != "conversations":  # one row a conversation or node
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in ORACLES:
        duck = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "embeddings"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = duck.execute(ORACLES[name])
        assert sorted(frame.columns) == sorted(d[0] for d in result.description)
        assert rows_of(frame.columns, rows) == rows_of(
            [d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.split("_")[0] in ("op1", "op2")])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for banned in ("Python", "Arrow", "Cartesian", "BroadcastNestedLoopJoin"):
        assert banned not in plan
