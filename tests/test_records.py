"""Validation, alignment, duplicates and the preview / confirm plans."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import dedupe, validate
from sluice.operators.align import align_maps
from sluice.plans.submission import confirm, direct_import, preview
from sluice.plans.targets import CATEGORIES, PRODUCTS, TARGETS, USERS

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def records(spark, maps, submission="s"):
    rows = [(submission, i, m, None) for i, m in enumerate(maps, 1)]
    return spark.createDataFrame(
        rows, "submission_id string, row_index long, fields map<string,string>, reason string")


def reasons(frame):
    return {r.row_index: r.reason for r in frame.collect() if r.reason is not None}


P = {"sku": "a1", "name": "N", "price": "1"}


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"sku": None}, "no 'sku' column could be found for this record"),
    ({"name": None, "price": None}, "no 'name' column could be found for this record"),
    ({"sku": " "}, "'sku' must not be blank"),
    ({"sku": "a" * 65}, "'sku' must be <= 64 characters"),
    ({"sku": "a b"}, "'sku' must contain only letters, digits, '-', or '_'"),
    ({"name": "é" * 101}, "'name' must be <= 200 characters"),
    ({"name": "é" * 100}, None),
    ({"price": ""}, "'price' must not be blank"),
    ({"price": "abc.def"}, "'price' must have at most 2 decimal places"),
    ({"price": "1d"}, "'price' must be a valid number"),
    ({"price": "-1.00"}, "'price' must be between 0 and 10000000.000000"),
    ({"price": "nan"}, "'price' must be between 0 and 10000000.000000"),
    ({"currency": "us"}, "'currency' must be a 3-letter currency code"),
    ({"category": "c" * 101}, "'category' must be <= 100 characters"),
    ({"description": "d" * 2001}, "'description' must be <= 2000 characters"),
    ({"stock_quantity": "x"}, "'stock_quantity' must be a whole number"),
    ({"stock_quantity": "-1"}, "'stock_quantity' must be between 0 and 10000000"),
    ({"sku": " ", "price": "x"}, "'sku' must not be blank"),
])
def test_product_rules(spark, change, reason):
    fields = {k: v for k, v in {**P, **change}.items() if v is not None}
    got = validate.validate_products(align_maps(records(spark, [fields]), PRODUCTS)).first()
    assert got.reason == reason
    if not change:
        assert (got.sku, got.currency, got.stock_quantity, str(got.price)) == (
            "A1", "USD", 0, "1.00")


@pytest.mark.parametrize("fields, slug, parent, reason", [
    ({"name": "Home & Garden"}, "home-garden", None, None),
    ({"name": "A", "slug": " My Slug! ", "parent": " "}, "my-slug", None, None),
    ({"name": "A", "parent": "Top Level"}, "a", "top-level", None),
    ({"name": "###"}, "", None,
     "could not derive a valid slug: '###' contains no letters or digits"),
    ({"name": "A", "slug": "!!"}, "", None,
     "could not derive a valid slug: '!!' contains no letters or digits"),
    ({"name": "A", "parent": "!!"}, "a", "",
     "'parent_slug' (\"!!\") contains no letters or digits"),
    ({"name": "A", "parent": " a "}, "a", "a", "a category cannot be its own parent"),
    ({"slug": "a"}, "a", None, "no 'name' column could be found for this record"),
])
def test_category_rules(spark, fields, slug, parent, reason):
    got = validate.validate_categories(align_maps(records(spark, [fields]), CATEGORIES)).first()
    assert (got.slug, got.parent_slug, got.reason) == (slug, parent, reason)


def test_label_of_lowest_bytes_wins(spark):
    got = align_maps(records(spark, [{"sku": "x", "Code": "y"}, {"sku": "x", " SKU ": "z"},
                                     {"code": "c", "sku": "x"}]), PRODUCTS)
    assert [r.sku for r in got.orderBy("row_index").collect()] == ["y", "z", "c"]


def test_only_valid_rows_take_part_in_duplicates(spark):
    rows = records(spark, [{"name": "", "email": "a@b.c"}, {"name": "A", "email": "A@B.C"},
                           {"name": "B", "email": "a@b.c "}, {"name": "C", "email": "c@d.e"}])
    checked = validate.validate_users(align_maps(rows, USERS))
    assert reasons(dedupe.keep_first(checked, "email")) == {
        1: "'name' must not be blank",
        3: "duplicate email 'a@b.c' in this submission -- only the first occurrence is kept"}
    assert reasons(dedupe.keep_first_naming_row(checked, "email"))[3] == (
        "duplicate email (first seen at row 2)")


def test_duplicates_of_one_hot_key(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot", "hot", f"k{rng.randint(0, 500)}"]) for _ in range(5000)]
    rows = spark.createDataFrame([("s", i, k, None) for i, k in enumerate(keys)],
                                 "submission_id string, row_index long, key string, reason string")
    kept = {r.row_index for r in dedupe.keep_first(rows.repartition(5), "key").collect()
            if r.reason is None}
    assert kept == {keys.index(k) for k in set(keys)}


def test_bounded_rejects(spark):
    rejects = spark.createDataFrame(
        [("a", i, "r") for i in range(1, 451)] + [("b", i, "r") for i in range(1, 11)],
        "submission_id string, row_index long, reason string").repartition(3)
    shown = validate.bounded_rejects(rejects, 200).collect()
    assert sorted(r.row_index for r in shown if r.submission_id == "a") == list(range(1, 201))
    assert len([r for r in shown if r.submission_id == "b"]) == 10
    totals = {r.submission_id: (r.rejected, r.truncated)
              for r in validate.reject_totals(rejects, 200).collect()}
    assert totals == {"a": (450, True), "b": (10, False)}


def csv_file(spark, text):
    return spark.createDataFrame([("s", bytearray(text.encode()))],
                                 "submission_id string, content binary")


BAD_ROWS = (17, 34, 51, 68, 85)


def hundred(target):
    """A file of 100 rows, five of them faulty, in the published shape."""
    lines = []
    for i in range(1, 101):
        bad = i in BAD_ROWS
        lines.append({
            "users": f"Bulk User {i},{'bulk' if bad else f'bulkuser{i}@example.com'},555-{i:04d}",
            "products": f"PROD-{i:03d},Thing {i},{'-1.00' if bad else f'{4.99 + 1.37 * i:.2f}'},"
                        f"{'' if i % 10 == 0 else 'EUR'},Tools,,{i}",
            "categories": f"{'###' if bad else f'Category {i:03d}'},,About {i},"}[target])
    return "\n".join([",".join(TARGETS[target].columns), *lines])


@pytest.mark.parametrize("target", ["users", "products", "categories"])
def test_hundred_rows_give_95_and_5(spark, target):
    from sluice.sources.csv import extract_csv
    rows, _ = extract_csv(csv_file(spark, hundred(target)))
    plan = preview(rows, TARGETS[target])
    summary = plan.summary.first()
    assert (summary.total_records, summary.valid_records, summary.invalid_records) == (100, 95, 5)
    assert sorted(r.row_index for r in plan.rejects.collect()) == list(BAD_ROWS)
    done = confirm(rows, TARGETS[target], now())
    assert done.jobs.count() == 95 and done.workloads.first().total_items == 95
    assert {r.job_type for r in done.jobs.collect()} == {TARGETS[target].job_type}
    if target == "products":
        usd = plan.records.filter("currency = 'USD'").count()
        assert usd == 10


def test_preview_keeps_original_positions(spark):
    from sluice.sources.csv import extract_csv
    text = "Product Code,Title,Cost\nA,a,1\nB,b\n\nC,c,x\nA,a,2\nD,d,3"
    rows, _ = extract_csv(csv_file(spark, text))
    plan = preview(rows, PRODUCTS)
    got = {r.row_index: (r.stage, r.reason) for r in plan.rejects.collect()}
    assert got == {
        2: ("structural", "expected 3 fields, found 2"),
        3: ("mapping", "'price' must be a valid number"),
        4: ("mapping", "duplicate sku 'A' in this submission -- only the first occurrence is kept")}
    assert sorted(r.sku for r in plan.records.collect()) == ["A", "D"]


def test_confirm_uses_exact_names_and_marks_parents(spark):
    rows = records(spark, [{"name": "Laptops", "parent_slug": "Electronics"},
                           {"name": "Electronics"}, {"Name": "x"},
                           {"name": "Orphan", "parent_slug": "ghost"}, {"name": "laptops"}])
    done = confirm(rows, CATEGORIES, now())
    assert reasons(done.rejects) == {
        3: "'name' is required",
        5: "duplicate key 'laptops' in this submission -- only the first occurrence is kept"}
    payloads = sorted(r.payload for r in done.jobs.collect())
    assert payloads == [
        '{"name":"Electronics","slug":"electronics"}',
        '{"name":"Laptops","slug":"laptops","parent_slug":"electronics",'
        '"parent_in_submission":"true"}',
        '{"name":"Orphan","slug":"orphan","parent_slug":"ghost"}']
    users = confirm(records(spark, [{"name": "a"}]), USERS, now())
    assert reasons(users.rejects) == {1: "'name' and 'email' are required"}
    products = confirm(records(spark, [{"name": "a"}]), PRODUCTS, now())
    assert reasons(products.rejects) == {1: "'sku', 'name', and 'price' are required"}


def test_confirm_twice_gives_the_same_ids(spark):
    rows = records(spark, [{"name": "A", "email": "a@b.c"}, {"name": "B", "email": "b@b.c"}])
    first, second = (sorted(r.id for r in confirm(rows, USERS, now()).jobs.collect())
                     for _ in range(2))
    assert first == second and len(set(first)) == 2


def test_direct_import(spark):
    text = "email,name\nANN@x.co,Ann\nann@x.co,Other\nnope,Bob\n,Zed"
    done, refused = direct_import(csv_file(spark, text), now())
    assert reasons(done.rejects) == {
        2: "duplicate email (first seen at row 1)", 3: "'email' must be a valid email address",
        4: "'email' must be a valid email address"}
    assert refused.count() == 0
    assert [r.payload for r in done.jobs.collect()] == ['{"name":"Ann","email":"ann@x.co"}']
    _, refused = direct_import(csv_file(spark, "Email,name\n"), now())
    assert refused.first().reason.startswith("CSV header has an unexpected column 'Email'")
