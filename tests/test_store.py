"""Versions over several tables: visibility, refused writers, buckets, folded logs."""

import pytest
from pyspark.sql import functions as F

from sluice.operators.upsert import upsert
from sluice.sources.store import Conflict, Store, bucket

SCHEMA = "sku string, name string, id int, created_at int"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def files_of(frame):
    return set(frame.inputFiles())


def test_a_batch_is_visible_as_a_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.log("jobs") is None and store.rows("products") is None
    rows = spark.createDataFrame([("a", "A", 1, 1)], SCHEMA)
    killed = store.begin()
    killed.append("jobs", rows)
    killed.upsert("products", rows, ["sku"], buckets=4)
    # Its data is on disk, but no version names it.
    assert store.state().version == 0 and store.log("jobs") is None
    batch = store.begin()
    batch.append("jobs", rows.limit(0))
    batch.upsert("products", rows, ["sku"], buckets=4)
    batch.commit()
    assert rows_of(store.rows("products")) == [("a", "A", 1, 1)]
    assert store.log("jobs").count() == 0
    store.expire()
    assert len(list((tmp_path / "jobs").iterdir())) == 1
    assert rows_of(store.rows("products")) == [("a", "A", 1, 1)]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, second = store.begin(), store.begin()
    for n, batch in enumerate((first, second)):
        batch.upsert("products", spark.createDataFrame([("a", f"writer {n}", n, n)], SCHEMA), ["sku"])
    assert second.commit() == 1
    with pytest.raises(Conflict):
        first.commit()
    assert rows_of(store.rows("products")) == [("a", "writer 1", 1, 1)]
    again = store.begin()
    again.upsert("products", spark.createDataFrame([("a", "retry", 5, 5)], SCHEMA), ["sku"])
    again.commit()
    # Id and creation time stay as first written.
    assert rows_of(store.rows("products")) == [("a", "retry", 1, 1)]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    base = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("sku"), F.lit("x").alias("name"),
                                    F.col("id").cast("int").alias("id"), F.lit(1).alias("created_at"))
    batch = store.begin()
    batch.upsert("products", base, ["sku"], buckets=16)
    batch.commit()
    before = files_of(store.rows("products"))
    assert len(before) == 16
    change = spark.createDataFrame([("s7", "new", 9, 9), ("other", "born", 3, 9)], SCHEMA)
    touched = {r[0] for r in change.select(bucket(["sku"], 16)).collect()}
    batch = store.begin()
    batch.upsert("products", change, ["sku"], buckets=99)
    batch.commit()
    after = files_of(store.rows("products"))
    assert len(before & after) == 16 - len(touched) and len(after) == 16
    assert rows_of(store.rows("products")) == rows_of(upsert(base, change, ["sku"]))
    # Older versions are still there, and a lookup reads the keys' buckets alone.
    assert rows_of(store.rows("products", store.state(1))) == rows_of(base)
    wanted = spark.createDataFrame([("s7", 1), ("nowhere", 2), (None, 3)], "sku string, n int")
    found = store.find("products", wanted, ["n"])
    assert {(r["sku"], r["name"]) for r in found.collect()} == {
        ("s7", "new"), ("nowhere", None), (None, None)}
    assert len(files_of(store.rows("products", only=[3]))) == 1
    store.expire(keep=1)
    assert rows_of(store.rows("products")) == rows_of(upsert(base, change, ["sku"]))


def test_a_stream_batch_is_applied_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "A", 1, 1)], SCHEMA)
    for number in (0, 1, 1, 0, 2):
        batch = store.begin("ingest", number)
        if batch:
            batch.append("jobs", rows)
            batch.commit()
    assert store.log("jobs").count() == 3 and store.state().applied == {"ingest": 2}
    assert store.begin("other", 0) is not None


def test_folded_logs_read_the_same_from_fewer_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def total(log):
        return log.groupBy("name").agg(F.sum("n").alias("n"))

    for i in range(6):
        batch = store.begin()
        batch.append("sums", spark.createDataFrame([("a", i), ("b", 1)], "name string, n bigint"))
        batch.commit()
        if i == 3:
            store.fold("sums", total)
            assert len(store.state().logs["sums"]["paths"]) == 1
    assert len(store.state().logs["sums"]["paths"]) == 3
    assert rows_of(total(store.log("sums"))) == [("a", 15), ("b", 6)]
