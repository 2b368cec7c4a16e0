"""Every named query beside its oracle, and rules every plan must keep."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sluice import catalog
from sluice.catalog.base import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) and not math.isnan(value) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    assert table(frame.columns, frame.collect()) == table(
        [d[0] for d in result.description], result.fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas",
                   "FlatMapGroupsInPandas", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan, banned
    # A window without a partition would put the whole table into one task.
    for window in re.findall(r"^.*\bWindow \[.*$", plan, re.M):
        assert not re.search(r"windowspecdefinition\([^,]* (ASC|DESC)", window), window


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_duplicate_search_shuffles_its_aggregate_once(spark):
    frame = entry.queries()["win1_dedupe_keep_first"](spark, "/root/testdata/sf0.01")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
    assert plan.count("FileScan") == 2
