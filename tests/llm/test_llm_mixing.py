"""Mixing: water level by brute force, odd rows, and the SQL beside it."""

import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing
from sluice.llm.common import ready

SCHEMA = "doc_id bigint, text string, source string, size int, copies string, target double"


def frame(spark, rows):
    ready(spark)
    return spark.createDataFrame([(*r, 1, "c", 0.5) for r in rows], SCHEMA)


def level_by_resharing(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by handing excess on until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = sum(weight[s] for s in open_) or 1
        target = {s: left * weight[s] / share for s in open_} | capped
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 5, "d": 1, None: 40},
    {"a": 1, "b": 1000}, {"é": 7, "z": 50, "Z": 60, "": 9}, {"x": 12}])
def test_targets_are_the_resharing_limit(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = level_by_resharing(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_odd_rows_have_defined_copies(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "d e", None),
            (3, "", "empty"), (4, " \t\n", "empty"), (5, "w " * 30_000, "y")]
    docs = frame(spark, rows)
    planned, name = mixing.plan_copies(docs)
    got = planned.select("doc_id", "source", F.col(name["size"]).alias("n"),
                         F.col(name["copies"]).alias("k")).collect()
    assert len(got) == len(rows) and all(0 <= r["k"] <= 3 for r in got)
    assert {r["n"] for r in got if r["source"] == "empty"} == {0}
    assert {r["k"] for r in got if r["source"] == "empty"} == {0}
    assert len({r["k"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).collect() == mixing.mix(docs).collect()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (20 + i % 7), f"s{i % 3}" if i % 3 else "s0") for i in range(6000)]
    planned, name = mixing.plan_copies(frame(spark, rows))
    sums = planned.groupBy("source").agg(
        F.sum(F.col(name["copies"]) * F.col(name["size"])).alias("taken"),
        F.first(name["target"]).alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in sums)
