"""Job operators against sequential Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import jobs, metrics, paging, progress, quality, upsert, workflows
from sluice.plans.handlers import HandlerRegistry, builtin_registry
from sluice.plans.targets import CATEGORIES, PRODUCTS, USERS

T0 = dt.datetime(2024, 1, 1)
JOB = ("id long, status string, attempt_count int, max_attempts int, last_error string, "
       "updated_at timestamp_ntz")
ATTEMPT = ("job_id long, attempt_id long, started_at timestamp_ntz, finished_at timestamp_ntz, "
           "outcome string, retryable boolean, error_message string")


def fold(job, attempts):
    """One attempt after another, as a worker would."""
    job_id, status, count, limit, error, changed = job
    for a in attempts:
        if status in ("succeeded", "cancelled", "dead_letter"):
            break
        _, _, _, finished, outcome, retryable, message = a
        changed = finished
        if outcome == "cancelled":
            status = "cancelled"
            continue
        count += 1
        if outcome == "succeeded":
            status = "succeeded"
            continue
        error = message
        if outcome == "failed" and retryable:
            status = "dead_letter" if count >= limit else "retrying"
        else:
            status = "failed"
    return job_id, status, count, limit, error, changed


def test_apply_attempts_folds_in_order(spark):
    rng = random.Random(11)
    job_rows, attempt_rows = [], []
    for j in range(300):
        status = rng.choice(["queued", "running", "failed", "retrying", "succeeded", "cancelled"])
        job_rows.append((j, status, rng.randint(0, 3), rng.randint(1, 6),
                         rng.choice([None, "old"]), T0))
        for _ in range(rng.choice([0, 1, 2, 5, 9]) if j else 400):
            start = T0 + dt.timedelta(hours=rng.randint(0, 100))
            attempt_rows.append((
                j, len(attempt_rows), start, start + dt.timedelta(seconds=rng.randint(1, 50)),
                rng.choices(["succeeded", "failed", "timed_out", "cancelled"], [1, 12, 2, 1])[0],
                rng.random() < 0.5, f"e{len(attempt_rows)}"))
    attempt_rows.append((999, 10**6, T0, T0, "succeeded", False, "no such job"))
    job_rows[0] = (0, "queued", 0, 10_000, None, T0)
    expected = {j[0]: fold(j, sorted((a for a in attempt_rows if a[0] == j[0]),
                                     key=lambda a: (a[2], a[1]))) for j in job_rows}
    got = jobs.apply_attempts(spark.createDataFrame(job_rows, JOB),
                              spark.createDataFrame(attempt_rows, ATTEMPT).repartition(5))
    assert {r.id: (r.id, r.status, r.attempt_count, r.max_attempts, r.last_error, r.updated_at)
            for r in got.collect()} == expected


@pytest.mark.parametrize("ends_by", ["budget", "success", "nothing"])
def test_a_job_with_all_attempts_in_one_second(spark, ends_by):
    job_rows = [(1, "queued", 2, 1502 if ends_by == "budget" else 10**6, None, T0),
                (2, "queued", 0, 3, None, T0)]
    attempt_rows = [(1, i, T0, T0 + dt.timedelta(seconds=i), "failed" if i % 3 else "timed_out",
                     True, f"e{i}") for i in range(3000)]
    if ends_by == "success":
        attempt_rows[1700] = (1, 1700, T0, T0, "succeeded", False, None)
    attempt_rows.append((2, 5000, T0, T0, "cancelled", False, "stop"))
    expected = {j[0]: fold(j, [a for a in attempt_rows if a[0] == j[0]]) for j in job_rows}
    random.Random(3).shuffle(attempt_rows)
    got = jobs.apply_attempts(spark.createDataFrame(job_rows, JOB),
                              spark.createDataFrame(attempt_rows, ATTEMPT).repartition(5))
    assert {r.id: (r.id, r.status, r.attempt_count, r.max_attempts, r.last_error, r.updated_at)
            for r in got.collect()} == expected


def test_the_log_of_attempts_is_scanned_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, T0, T0, "failed", True, "e")], ATTEMPT).write.parquet(
        str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    job = spark.createDataFrame([(1, "queued", 0, 3, None, T0)], JOB)
    plan = jobs.apply_attempts(job, log)._jdf.queryExecution().optimizedPlan().toString()
    # What the plan reads is the written, numbered log.
    assert str(tmp_path / "log") not in plan and "started_at" not in plan


def test_attempt_numbers_and_outcomes(spark):
    rows = [(1, i, T0 + dt.timedelta(days=3 - i), T0 + dt.timedelta(days=3 - i, seconds=i),
             ["failed", "failed", "succeeded", "timed_out"][i], i == 1, "e") for i in range(4)]
    numbered = jobs.number_attempts(spark.createDataFrame(rows, ATTEMPT))
    assert {r.attempt_id: r.attempt_number for r in numbered.collect()} == {3: 1, 2: 2, 1: 3, 0: 4}
    counts = {r.result: (r.attempts, r.total_ms) for r in progress.attempt_outcomes(
        numbered.withColumn("max_attempts", F.lit(3))).collect()}
    assert counts == {"timed_out": (1, 3000), "succeeded": (1, 2000), "dead_letter": (1, 1000),
                      "failed": (1, 0)}


def test_due_retries_are_not_crowded_out(spark):
    policy = F.struct(F.col("wait").alias("initial_backoff_ms"),
                      F.lit(10**9).alias("max_backoff_ms"),
                      F.lit(2.0).alias("backoff_multiplier"))
    rows = [(i, "retrying", T0, 10**8) for i in range(60)] + [
        (100, "retrying", T0 + dt.timedelta(minutes=5), 1000),
        (101, "queued", T0, 1000), (102, "retrying", T0 + dt.timedelta(hours=1), 1000)]
    table = spark.createDataFrame(rows, "id long, status string, updated_at timestamp_ntz, "
                                        "wait long")
    table = table.select("*", F.lit(1).alias("attempt_count"), policy.alias("retry_policy"))
    now = lambda t: F.lit(t).cast("timestamp")
    assert [r.id for r in jobs.due_retries(table, now("2024-01-01 00:05:01")).collect()] == [100]
    assert jobs.due_retries(table, now("2024-01-01 00:05:00.999")).count() == 0
    latest = table.withColumn("status", F.lit("cancelled"))
    due = jobs.due_retries(table, now("2024-01-02"), n=None)
    assert due.count() == 2 and jobs.still_retrying(due, latest).count() == 0


def test_admission_and_queue_order(spark):
    rows = [(i, "hot" if i % 3 else "cold", i % 5, T0 + dt.timedelta(seconds=i // 2))
            for i in range(900)]
    table = spark.createDataFrame(rows, "id long, queue_name string, priority int, "
                                        "created_at timestamp_ntz").repartition(4)
    admitted = {r.id for r in jobs.admit_by_capacity(table, 100).filter("admitted").collect()}
    expected = {r[0] for q in ("hot", "cold") for r in sorted(
        (r for r in rows if r[1] == q), key=lambda r: (r[3], r[0]))[:100]}
    assert admitted == expected
    following = [r.id for r in jobs.next_of_queue(table, 5).filter("queue_name = 'hot'")
                 .orderBy("turn").collect()]
    assert following == [r[0] for r in sorted((r for r in rows if r[1] == "hot"), key=lambda r: (
        -r[2], r[3], r[0]))[:5]]


def test_requests_commands_and_schedulability(spark):
    base = {"queue_name": "q", "payload": "p", "job_type": "t", "max_attempts": 1}
    cases = [({}, None), ({"queue_name": ""}, "queue_name must not be empty"),
             ({"queue_name": "q" * 129}, "queue_name must be <= 128 characters"),
             ({"payload": ""}, "payload must not be empty"),
             ({"payload": "p" * 262145}, "payload must be <= 262144 bytes"),
             ({"job_type": "t" * 129}, "job_type must be <= 128 characters"),
             ({"max_attempts": 0}, "retry_policy.max_attempts must be >= 1")]
    frame = spark.createDataFrame([{**base, "n": i, **c} for i, (c, _) in enumerate(cases)])
    got = jobs.check_job_requests(frame).orderBy("n").collect()
    assert [r.reason for r in got] == [reason for _, reason in cases]
    table = spark.createDataFrame([(1, "succeeded", "a"), (2, "failed", ""), (3, "queued", "b"),
                                   (4, "failed", "a")], "id int, status string, job_type string")
    got = {r.id: r.reason for r in jobs.check_schedulable(table, ["a"]).collect()}
    assert got == {1: "job '1' is already in a terminal state",
                   2: "job '2' has no job_type; cannot be scheduled for execution",
                   3: "no handler registered for job type 'b'", 4: None}
    commands = spark.createDataFrame([(1, 1, "cancel"), (2, 4, "cancel"), (3, 3, "queue"),
                                      (4, 9, "queue")],
                                     "command_id int, job_id int, command string")
    done = {r.command_id: (r.outcome, r.new_status)
            for r in jobs.apply_commands(commands, table).collect()}
    assert done == {1: ("conflict", "succeeded"), 2: ("applied", "cancelled"),
                    3: ("applied", "queued"), 4: ("not_found", None)}


def test_progress_of_hot_and_empty_workloads(spark):
    statuses = ["succeeded", "failed", "retrying", "dead_letter", "running", "pending",
                "cancelled", "queued"]
    rows = [(i, "big", statuses[i % 8]) for i in range(800)] + [(900, None, "queued")]
    work = spark.createDataFrame([("big", "t", 800), ("none", "t", 0), ("new", "t", 3)],
                                 "id string, type string, total_items long")
    got = {r.id: r for r in progress.workload_progress(work, spark.createDataFrame(
        rows, "id int, workload_id string, status string")).collect()}
    big = got["big"]
    assert (big.queued_items, big.running_items, big.completed_items, big.failed_items,
            big.retrying_items, big.dead_letter_items) == (300, 100, 100, 300, 100, 100)
    assert (big.status, big.percent) == ("running", 50)
    assert (got["none"].status, got["none"].percent) == ("succeeded", 100)
    assert (got["new"].status, got["new"].percent) == ("running", 0)


def test_upsert(spark):
    schema = "key string, name string, phone string, id int, created_at int"
    old = spark.createDataFrame([("a", "A", "1", 1, 10), ("b", "B", "2", 2, 20)], schema)
    new = spark.createDataFrame([("b", "B2", None, 7, 99), ("c", "C", "3", 3, 99)], schema)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    once = upsert.upsert(old, new, ["key"])
    assert rows(once) == [("a", "A", "1", 1, 10), ("b", "B2", None, 2, 20), ("c", "C", "3", 3, 99)]
    assert rows(upsert.upsert(once, new, ["key"])) == rows(once)
    assert rows(upsert.insert_if_absent(old, new, ["key"])) == [("c", "C", "3", 3, 99)]


def test_strict_insert_and_attempt_log(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    upsert.append_attempts(rows, path)
    with pytest.raises(ValueError, match="conflict"):
        upsert.insert_strict(spark.read.parquet(path), rows.limit(1), ["id"], path)
    with pytest.raises(ValueError, match="conflict"):
        twice = spark.createDataFrame([(5, "x"), (5, "y")], "id int, v string")
        upsert.insert_strict(spark.read.parquet(path), twice, ["id"], path)
    upsert.insert_strict(spark.read.parquet(path), spark.createDataFrame(
        [(3, "c")], "id int, v string"), ["id"], path)
    assert spark.read.parquet(path).count() == 3


def test_metrics_text(spark):
    rows = [("c", "counter", 2.0, 1), ("c", "counter", 3.0, 2), ("g", "gauge", 7.0, 1),
            ("g", "gauge", 4.0, 9), ("h", "histogram", 1.5, 1), ("h", "histogram", 0.5, 2)]
    samples = spark.createDataFrame(rows, "name string, kind string, value double, ts long")
    assert [r.line for r in metrics.metrics_text(samples).collect()] == [
        "c 5.0", "g 4.0", "h_count 2.0", "h_sum 2.0", "h_min 0.5", "h_max 1.5"]


def test_page_arguments():
    assert [paging.clamp_job_limit(n) for n in (0, 1, 500, 501)] == [500, 1, 500, 500]
    assert [paging.clamp_item_limit(n) for n in (0, 200, 201)] == [200, 200, 200]
    assert [paging.clamp_domain_limit(n) for n in (0, 50, 999)] == [0, 50, 200]
    assert [paging.size_parameter(r, 50) for r in (None, "7", "-1", "x", "")] == [
        50, 7, 50, 50, 50]


def test_documents(spark):
    import json
    policy = F.struct(F.lit(3).alias("max_attempts"))
    table = spark.createDataFrame([(2, '{"b": 1}'), (1, "plain"), (3, "3")],
                                  "id int, payload string").select(
        "*", *[F.lit("x").alias(c) for c in ("queue_name", "job_type", "status")],
        F.lit(0).alias("priority"), F.lit(0).alias("attempt_count"), policy.alias("retry_policy"),
        *[F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias(c)
          for c in ("created_at", "updated_at")],
        *[F.lit(None).cast("string").alias(c) for c in ("last_error", "workload_id")])
    body = json.loads(paging.envelope(table, paging.job_document(), "jobs", 2, 1)
                      .first().document)
    assert (body["total"], body["limit"], body["offset"]) == (3, 2, 1)
    assert [(j["id"], j["payload"]) for j in body["jobs"]] == [(2, {"b": 1}), (3, 3)]
    assert body["jobs"][0]["last_error"] is None and "workload_id" in body["jobs"][0]
    assert body["jobs"][0]["created_at"] == "2024-01-02T03:04:05.000Z"
    item = json.loads(table.filter("id = 1").select(
        paging.item_document().alias("d")).first().d)
    assert item["name"] is None and item["job_id"] == 1


def test_quality_report(spark):
    rows = spark.createDataFrame([(1, "a", -1), (1, "b", 0), (2, None, 5)],
                                 "id int, ref string, n int")
    checks = quality.check_violations(rows, {"n >= 0": F.col("n") >= 0,
                                             "ref = a": F.col("ref") == "a"})
    assert {r.rule: r.violations for r in checks.collect()} == {"n >= 0": 1, "ref = a": 1}
    assert quality.unique_violations(rows, ["id"], "u").first().violations == 1
    known = spark.createDataFrame([("a",)], "k string")
    assert quality.reference_violations(rows, "ref", known, "k", "f").first().violations == 1
    assert [r.ref for r in quality.unknown_values(rows, "ref", ["a"]).collect()] == ["b"]


def test_workflows_of_any_size(spark):
    steps = [(w * 10_000 + p, w, 7, f"s{p}", p) for w, n in ((1, 3), (2, 2500)) for p in range(n)]
    edges = [(20_000 + 2499, 20_000 + p) for p in range(2400)] + [(10_001, 10_000)]
    flows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    steps = spark.createDataFrame(steps, "id int, workflow_id int, job_id int, name string, "
                                         "position int")
    edges = spark.createDataFrame(edges, "step_id int, depends_on_step_id int")
    got = {r.id: r.steps for r in workflows.workflow_documents(flows, steps, edges).collect()}
    assert got[3] == [] and [s.position for s in got[2]] == list(range(2500))
    assert got[2][-1].depends_on == list(range(20_000, 22_400))
    assert [s.depends_on for s in got[1]] == [[], [10_000], []]
    assert workflows.workflow_steps(flows.filter("id = 2"), steps).count() == 2500
    assert workflows.step_dependencies(flows.filter("id = 1"), steps, edges).count() == 1


def job_rows(spark, kind, payloads):
    return spark.createDataFrame([(i, p, kind, i) for i, p in enumerate(payloads)],
                                 "id int, payload string, job_type string, created_at int")


def test_handlers(spark):
    stored = spark.createDataFrame([("top", None)], "slug string, parent_slug string")
    registry = builtin_registry(stored)
    assert registry.types() == ["category.process", "product.process", "transform",
                                "user.process"]
    with pytest.raises(ValueError):
        registry.register("transform", None)
    with pytest.raises(KeyError):
        HandlerRegistry().resolve("x")
    rows = (job_rows(spark, USERS.job_type, ['{"name":" A ","email":"A@b.c"}', '{"name":"A"}'])
            .unionByName(job_rows(spark, "transform", ["é a"]).withColumn("id", F.lit(10)))
            .unionByName(job_rows(spark, "what", ["x"]).withColumn("id", F.lit(11)))
            .unionByName(job_rows(spark, PRODUCTS.job_type, ['{"sku":"a","name":"n","price":"x"}'])
                         .withColumn("id", F.lit(12)))
            .unionByName(job_rows(spark, CATEGORIES.job_type, [
                '{"name":"Kid","slug":"kid","parent_slug":"mid"}',
                '{"name":"Mid","slug":"mid","parent_slug":"top"}',
                '{"name":"Lost","slug":"lost","parent_slug":"ghost"}'])
                .withColumn("id", F.col("id") + 20)))
    got = {r.id: (r.status, r.output, r.error) for r in registry.run(rows).collect()}
    assert got[0] == ("succeeded", '{"name":"A","email":"a@b.c"}', None)
    assert got[1] == ("failed", None, "'email' is required and must be a JSON string")
    assert got[10] == ("succeeded", "é A", None)
    assert got[11][2] == "no handler registered for job type 'what'"
    assert got[12][2] == "'price' must be a valid number"
    assert got[20][0] == got[21][0] == "succeeded"
    assert got[22][2].startswith("parent category 'ghost' does not exist")
