"""Column functions on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from sluice import functions as fn


def evaluate(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, function, cases, kind="string"):
    assert evaluate(spark, function, list(cases), kind) == list(cases.values())


def test_trim_and_case(spark):
    check(spark, fn.trim_ws, {" \t\n\x0b\x0c\r a b \r": "a b", " x": " x", "": ""})
    check(spark, fn.trim_header, {"\t a\x0b": "a\x0b"})
    check(spark, fn.ascii_lower, {"ÉAbZ": "Éabz"})
    check(spark, fn.ascii_upper, {"éaBz": "éABZ"})


def test_slugify(spark):
    check(spark, fn.slugify, {"Home & Garden": "home-garden", "  --A--  ": "a", "###": "",
                              "Café au lait": "caf-au-lait", "a_b.c": "a-b-c", "": ""})


def test_email(spark):
    check(spark, fn.is_email, {
        "a@b.c": True, "a@b.c.": True, "a@b..c": True, "a@.b.c": False, "a@b.": False,
        "a@b": False, "@b.c": False, "a@": False, "a@@b.c": False, "a@b@c.d": False, "": False,
        "a" * 316 + "@b.c": True, "a" * 317 + "@b.c": False, "é" * 158 + "@b.c": True,
        "é" * 159 + "@b.c": False, "a\n@b.c": True, "a@b.c\n": True})


def test_sku_and_currency(spark):
    check(spark, fn.is_sku, {"AB-1_2": True, "A B": False, "É": False, "A" * 64: True,
                             "A" * 65: False, "A\n": False})
    check(spark, fn.currency_code, {" usd ": "USD", "  ": "USD", "e": "E"})
    assert evaluate(spark, fn.currency_code, [None]) == ["USD"]
    check(spark, fn.is_currency, {"EUR": True, "EU": False, "EU1": False, "EURO": False})


def test_price(spark):
    price = lambda c: fn.parse_price(c).cast("double")
    check(spark, price, {
        "19.99": 19.99, "0": 0.0, "5.": 5.0, ".5": 0.5, "1e3": 1000.0, "10000000": 1e7,
        "10000000.01": None, "-0.01": None, "19.999": None, "+5": None, "5d": None, "abc": None,
        "1e400": None, "1e-400": None, "inf": None, "nan": None, "1,5": None, "0x10": None,
        "1e": None, "-0": 0.0, "1.5e3": None, "1_0": None})
    check(spark, fn.is_price_number, {"inf": True, "-Infinity": True, "NaN": True, "1e400": False,
                                      "x": False, "5": True})
    check(spark, fn.has_excess_decimals, {"1.23": False, "1.234": True, "1": False, "1.é": False,
                                          "1.éé": True, "..12": True})


def test_stock(spark):
    check(spark, fn.parse_stock, {
        "": 0, "7": 7, "-0": 0, "-1": None, "10000000": 10_000_000, "10000001": None, "1.5": None,
        "+3": None, "99999999999999999999": None})


def test_uuid_time_and_ids(spark):
    good = "0123abcd-89AB-4def-8123-0123456789ab"
    check(spark, fn.is_uuid, {good: True, good[:-1]: False, good.replace("-", "_"): False,
                              good[:-1] + "g": False})
    first, second = [spark.range(2).select(fn.stable_uuid(F.col("id"), F.lit(None)).alias("u"))
                     .collect() for _ in range(2)]
    assert first == second and first[0].u != first[1].u
    assert evaluate(spark, fn.is_uuid, [first[0].u]) == [True]
    made = spark.range(1).select(fn.is_uuid(fn.random_uuid()).alias("ok")).first()
    assert made.ok
    check(spark, lambda c: fn.to_iso8601(c.cast("timestamp_ntz")),
          {"2024-01-02 03:04:05.678999": "2024-01-02T03:04:05.678Z"})


@pytest.mark.parametrize("attempts, initial, ceiling, factor, expected", [
    (0, 1000, 60000, 2.0, 0), (1, 1000, 60000, 2.0, 1000), (3, 1000, 60000, 2.0, 4000),
    (7, 1000, 60000, 2.0, 60000), (5000, 1000, 60000, 2.0, 60000), (3, 1000, 60000, 1.5, 2250),
    (5000, 0, 60000, 2.0, 0), (3, 1000, 60000, 0.5, 250), (1, 90000, 60000, 2.0, 60000),
    (4, 100000, 200, 0.5, 200), (2, 300, 200, 0.5, 150), (3, 333, 60000, 1.5, 749)])
def test_backoff(spark, attempts, initial, ceiling, factor, expected):
    got = spark.range(1).select(fn.compute_backoff(
        F.lit(attempts), F.lit(initial), F.lit(ceiling), F.lit(factor)).alias("ms")).first().ms
    assert got == expected


def test_payloads(spark):
    text = 'say "hi" \\ there'
    row = spark.createDataFrame([(text, None)], "name string, phone string").select(
        fn.payload_json(F.col("name"), F.col("phone")).alias("p"))
    assert row.first().p == '{"name":"say \\"hi\\" \\\\ there"}'
    assert row.select(fn.payload_field(F.col("p"), "name").alias("n")).first().n == text
    check(spark, lambda c: fn.payload_field(c, "a"), {
        '{"a":"x"}': "x", '{"a": 1}': None, "nope": None, '{"b":"x"}': None, '{ "a" : "" }': ""})
    policy = ('{"max_attempts": 5, "initial_backoff_ms": 10, "max_backoff_ms": 20, '
              '"backoff_multiplier": 1.5}')
    got = evaluate(spark, fn.retry_policy_parse, [policy, '{"max_attempts": 5}', "x"])
    assert got[0].max_attempts == 5 and got[0].backoff_multiplier == 1.5
    assert got[1] is None and got[2] is None


def test_states(spark):
    check(spark, fn.classify_job_status, {
        "pending": "queued", "queued": "queued", "retrying": "queued", "running": "running",
        "succeeded": "succeeded", "failed": "failed", "cancelled": "failed",
        "dead_letter": "failed"})
    check(spark, fn.is_terminal, {"failed": False, "succeeded": True, "cancelled": True,
                                  "dead_letter": True, "retrying": False})
    for total, done, failed, status, percent in [
            (0, 0, 0, "succeeded", 100), (3, 1, 1, "running", 67), (2, 1, 1, "failed", 100),
            (2, 2, 0, "succeeded", 100), (8, 1, 0, "running", 13)]:
        row = spark.range(1).select(
            fn.derive_workload_status(F.lit(total), F.lit(done), F.lit(failed)).alias("s"),
            fn.progress_percent(F.lit(total), F.lit(done + failed)).alias("p")).first()
        assert (row.s, row.p) == (status, percent)
