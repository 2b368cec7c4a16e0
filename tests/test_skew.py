"""Helpers for hot keys, against plain Python on skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import skew

rng = random.Random(3)
# A third of the rows on one key, a third without a key, the rest spread out.
ROWS = [(i, rng.choice(["hot", None, f"k{rng.randint(0, 400)}"]), rng.randint(0, 5000))
        for i in range(6000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, key string, v int").repartition(6).cache()


@pytest.mark.parametrize("hot_keys", [1, 3, 256])
def test_lookup_is_a_left_join(spark, rows, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    values = {f"k{i}": i for i in range(0, 300)} | {"hot": -1}
    dims = spark.createDataFrame(list(values.items()), "key string, value int")
    got = skew.lookup(rows, dims, ["key"], ["id"])
    assert {(r.id, r.key, r.v, r.value) for r in got.collect()} == {
        (i, k, v, values.get(k)) for i, k, v in ROWS}
    assert got.count() == len(ROWS)


def test_lookup_of_a_hot_key_that_is_absent(spark, rows):
    dims = spark.createDataFrame([("k1", 1)], "key string, value int")
    got = skew.lookup(rows, dims, ["key"], ["id"])
    assert got.filter("value is not null and key <> 'k1'").count() == 0
    assert got.count() == len(ROWS)


def test_lookup_on_two_keys(spark, rows):
    dims = spark.createDataFrame([("hot", j, f"{j}!") for j in range(5)],
                                 "key string, d int, text string")
    got = skew.lookup(rows.withColumn("d", F.col("v") % 7), dims, ["key", "d"], ["id"])
    assert {(r.id, r.text) for r in got.collect()} == {
        (i, f"{v % 7}!" if k == "hot" and v % 7 < 5 else None) for i, k, v in ROWS}


def test_lookup_spreads_the_hot_key_over_tasks(spark, rows):
    dims = spark.createDataFrame([("hot", 1)], "key string, value int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.lookup(rows, dims, ["key"], ["id"]).filter("key = 'hot' or key is null")
        per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per_task) == 4 and max(per_task) < 2 * min(per_task)


def test_first_n(rows):
    got = skew.first_n(rows.filter("key is not null"), ["key"], [F.col("v"), F.col("id")], 7, ["id"])
    expected = set()
    for key in {k for _, k, _ in ROWS if k}:
        mine = sorted((v, i) for i, k, v in ROWS if k == key)[:7]
        expected |= {(key, i, n + 1) for n, (_, i) in enumerate(mine)}
    assert {(r.key, r.id, r["rank"]) for r in got.collect()} == expected


def test_number_rows(rows):
    got = skew.number_rows(rows.filter("key is not null"), ["key"], F.floor(F.col("v") / 500),
                           [F.col("v"), F.col("id")])
    numbers = {(r.key, r.id): r.number for r in got.collect()}
    for key in {k for _, k, _ in ROWS if k}:
        mine = sorted((v, i) for i, k, v in ROWS if k == key)
        assert [numbers[key, i] for _, i in mine] == list(range(1, len(mine) + 1))
