"""Confirm, run, store: what is stored, what is not, and what a killed batch leaves."""

import pytest
from pyspark.sql import functions as F

from sluice.plans import run
from sluice.plans.submission import confirm
from sluice.plans.targets import CATEGORIES, PRODUCTS
from sluice.sources.store import Store

RECORD = "submission_id string, row_index bigint, fields map<string,string>, reason string"


def day(n):
    return F.lit(f"2024-01-0{n}").cast("timestamp")


def records(spark, *rows):
    return spark.createDataFrame([(s, i, f, None) for s, i, f in rows], RECORD)


def product(sku, price="1.00", **more):
    return {"sku": sku, "name": f"name of {sku}", "price": price, **more}


def category(name, parent=None):
    return {"name": name} | ({"parent_slug": parent} if parent else {})


def test_products_are_stored_with_their_jobs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = records(spark, ("s", 1, product("a", "2.50", stock_quantity="7")), ("s", 2, product("b")),
                    ("s", 3, product("a")), ("s", 4, product("c", "-1")), ("r", 1, product("a", "9")))
    assert run.import_records(store, first, PRODUCTS, day(1)) == 1
    state = store.state()
    jobs = {r.id: r for r in store.log("jobs", state).collect()}
    assert len(jobs) == 3
    assert {(r.status, r.attempt_count, r.last_error) for r in jobs.values()} == {("succeeded", 1, None)}
    rows = {r.sku: r for r in store.rows("products", state).collect()}
    assert sorted(rows) == ["A", "B"] and rows["B"].stock_quantity == 0
    # Two submissions wrote A; the row names the job that wrote last, and that job alone.
    assert str(rows["A"].price) == ("2.50" if '"price":"2.50"' in jobs[rows["A"].job_id].payload else "9.00")
    assert {r.reason for r in store.log("rejects", state).collect()} == {
        "duplicate key 'A' in this submission -- only the first occurrence is kept",
        "'price' must be between 0 and 10000000.000000"}
    attempts = store.log("attempts", state).collect()
    assert sorted(r.job_id for r in attempts) == sorted(jobs) and {r.attempt_number for r in attempts} == {1}
    assert run.lost_keys(store, PRODUCTS).count() == 0

    run.import_records(store, records(spark, ("t", 1, product("a", "5"))), PRODUCTS, day(2))
    now = {r.sku: r for r in store.rows("products").collect()}
    assert now["A"].id == rows["A"].id and now["A"].job_id != rows["A"].job_id
    assert now["A"].created_at == rows["A"].created_at < now["A"].updated_at
    assert now["A"].stock_quantity == 0 and now["B"] == rows["B"]
    links = {r.sku: r for r in run.stored_provenance(store, PRODUCTS).collect()}
    assert all(r.job_status == "succeeded" and r.workload_type == "product.process"
               for r in links.values())
    assert links["A"].workload_id != links["B"].workload_id


def test_faulty_payloads_fail_without_a_row(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    done = confirm(records(spark, ("s", 1, product("a")), ("s", 2, product("b"))), PRODUCTS, day(1))
    broken = done.jobs.withColumn("payload", F.when(
        F.col("payload").contains('"B"'), F.lit('{"sku":"b","name":"n"}')).otherwise(F.col("payload")))
    result = run.run_jobs(broken, PRODUCTS, day(2))
    run.store_run(store, done, result, PRODUCTS)
    state = {r.status: r for r in store.log("jobs").collect()}
    assert state["failed"].last_error == "'price' is required and must be a JSON string"
    assert state["failed"].attempt_count == 1 and state["failed"].updated_at > state["failed"].created_at
    assert [r.sku for r in store.rows("products").collect()] == ["A"]
    assert {r.outcome for r in store.log("attempts").collect()} == {"succeeded", "failed"}


def test_a_killed_batch_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    batch = records(spark, ("s", 1, product("a")))
    commit = "sluice.sources.store.Batch.commit"

    def killed(self):
        raise RuntimeError("killed")

    monkeypatch.setattr(commit, killed)
    with pytest.raises(RuntimeError):
        run.import_records(store, batch, PRODUCTS, day(1), "ingest", 0)
    monkeypatch.undo()
    assert all(store.log(t) is None for t in ("jobs", "workloads", "attempts", "rejects"))
    assert store.rows("products") is None
    assert run.import_records(store, batch, PRODUCTS, day(1), "ingest", 0) == 1
    # The same micro-batch again changes nothing.
    assert run.import_records(store, batch, PRODUCTS, day(2), "ingest", 0) is None
    assert store.log("jobs").count() == 1 and store.state().version == 1


def test_categories_wait_for_parents_of_their_submission_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    run.import_records(store, records(spark, ("s", 1, category("Top"))), CATEGORIES, day(1))
    run.import_records(store, records(
        spark, ("t", 1, category("Leaf", "mid")), ("t", 2, category("Mid", "top")),
        ("t", 3, category("Lost", "ghost")), ("t", 4, category("Child", "lost"))), CATEGORIES, day(2))
    assert sorted(r.slug for r in store.rows("categories").collect()) == ["leaf", "mid", "top"]
    jobs = {r.slug: r for r in store.log("jobs").withColumn(
        "slug", F.get_json_object("payload", "$.slug")).collect()}
    assert (jobs["lost"].status, jobs["lost"].attempt_count) == ("failed", 1)
    assert (jobs["child"].status, jobs["child"].attempt_count) == ("dead_letter", 3)
    assert (jobs["leaf"].status, jobs["leaf"].attempt_count) == ("succeeded", 1)
    tries = store.log("attempts").filter(F.col("job_id") == jobs["child"].id).collect()
    assert sorted(r.attempt_number for r in tries) == [1, 2, 3]


def test_nothing_to_confirm_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="at least one record is required"):
        run.import_records(Store(spark, str(tmp_path)), records(spark), PRODUCTS, day(1))
