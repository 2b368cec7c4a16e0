"""Numbers along a sort order against plain counting, with a group that fills most ranges."""

import random

from pyspark.sql import functions as F

from sluice.operators.ranges import dense_index, number_by_range


def test_hot_group_of_one_second_is_numbered(spark):
    rng = random.Random(6)
    rows = [(7, "2024-01-01 00:00:00", i) for i in range(3000)]
    rows += [(rng.randint(0, 40), f"2024-01-0{rng.randint(1, 9)} 00:00:00", i)
             for i in range(3000, 5000)]
    rows += [(None, "2024-01-01 00:00:00", i) for i in range(5000, 5010)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id bigint, at string, id bigint").repartition(6)
    found = number_by_range(frame, ["job_id"], ["at", "id"], "n").collect()
    assert len(found) == len(rows)
    expected, last, n = {}, None, 0
    for job, at, i in sorted(r for r in rows if r[0] is not None):
        n = n + 1 if job == last else 1
        last = job
        expected[i] = n
    assert {r["id"]: r["n"] for r in found if r["job_id"] is not None} == expected
    assert all(r["n"] is None for r in found if r["job_id"] is None)


def test_index_is_dense_and_a_hot_group_lies_in_many_ranges(spark):
    frame = spark.range(20000).select((F.col("id") % 2).alias("g"), "id").repartition(5)
    found = dense_index(frame, ["g", "id"])
    rows = found.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(20000))
    assert [(r["g"], r["id"]) for r in rows] == sorted((i % 2, i) for i in range(20000))
    assert dense_index(frame.limit(0), ["g", "id"]).count() == 0
