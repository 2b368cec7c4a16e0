"""Streaming runs give the batch result, and replays change nothing."""

from pyspark.sql import functions as F

from sluice.operators.jobs import due_retries
from sluice.operators.progress import status_counts
from sluice.plans.submission import preview
from sluice.plans.targets import CATEGORIES, USERS
from sluice.sources import csv, tables
from sluice.sources.store import Store
from sluice.streaming import ingest, live


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_drop_folder_equals_batch(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    (drop / "a.csv").write_text("Name,E-mail,Phone\nAnn,ANN@x.co,1\nBob,bob@x.co,\nBob,bob@x.co,2\n")
    (drop / "b.csv").write_text("email,name\nzed@x.co,Zed\nbad,Bad\n")
    (drop / "c.csv").write_text('email,name\n"open\n')

    def run():
        files = ingest.file_stream(spark, str(drop), files_per_batch=1)
        ingest.start_ingest(files, USERS, root, str(tmp_path / "check")).awaitTermination()

    run()
    columns = ["email", "name", "phone"]
    store = Store(spark, root)
    users = store.rows("users")
    batch = preview(csv.extract_csv(csv.read_files(spark, str(drop)))[0], USERS)
    assert rows_of(users.select(columns)) == rows_of(batch.records.select(columns))
    jobs = store.log("jobs")
    assert jobs.select("id").distinct().count() == jobs.count() == 3
    assert users.join(jobs, users["job_id"] == jobs["id"]).filter("status = 'succeeded'").count() == 3
    refused = store.log("refused").collect()
    assert [r.reason for r in refused] == ["malformed CSV: unterminated quoted field"]
    assert store.log("rejects").count() == 2

    (drop / "d.csv").write_text("email,name\nann@x.co,Anna\n")
    run()
    users = store.rows("users")
    anna = users.filter("email = 'ann@x.co'").first()
    assert users.count() == 3 and anna.name == "Anna" and anna.phone is None
    assert anna.created_at < anna.updated_at


def test_category_parents_are_checked_per_batch(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()

    def land(name, *rows):
        (drop / name).write_text("name,slug,parent_slug\n" + "".join(f"{r}\n" for r in rows))
        files = ingest.file_stream(spark, str(drop), files_per_batch=1)
        ingest.start_ingest(files, CATEGORIES, root, str(tmp_path / "check")).awaitTermination()
        found = Store(spark, root).rows("categories")
        return {r.slug: r.parent_slug for r in found.collect()}

    # Children may come first; ghost is nowhere; b and c are each other's parent.
    first = land("a.csv", "Leaf,leaf,mid", "Mid,mid,top", "Top,top,", "Lost,lost,ghost", "B,b,c", "C,c,b")
    assert first == {"leaf": "mid", "mid": "top", "top": None}
    second = land("b.csv", "Lost,lost,leaf", "Top,top,leaf", "Deep,deep,lost")
    assert second == {"leaf": "mid", "mid": "top", "top": None, "lost": "leaf", "deep": "lost"}
    reasons = [r.reason for r in Store(spark, root).log("rejects").collect()]
    assert sum("does not exist" in r for r in reasons) == 1 and sum("cyclic" in r for r in reasons) == 3
    jobs = Store(spark, root).log("jobs")
    # leaf and mid came with their parents, deep with lost; lost's own parent was stored.
    assert jobs.count() == 5
    assert jobs.filter(F.get_json_object("payload", "$.parent_in_submission") == "true").count() == 3


def test_replayed_batch_writes_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "A", "a@b.c", None, None), ("s", 2, "", "x", None, "bad")],
                                 "submission_id string, row_index long, name string, email string,"
                                 " phone string, reason string")
    root = str(tmp_path)
    store = Store(spark, root)
    read = lambda n: rows_of(store.rows(n) if n == "users" else store.log(n))
    ingest.apply_records(rows, USERS, root, 4, "2024-01-01 00:00:00")
    first = [read(n) for n in ("jobs", "users", "workloads", "rejects")]
    ingest.apply_records(rows, USERS, root, 4, "2024-01-01 00:00:00")
    assert [read(n) for n in ("jobs", "users", "workloads", "rejects")] == first


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "email string, name string, id int, created_at int"
    frame = lambda *r: spark.createDataFrame(list(r), schema)
    assert tables.latest_snapshot(spark, root) is None
    tables.write_upsert(spark, root, frame(("a", "A", 1, 1), ("b", "B", 2, 1)), ["email"])
    tables.write_upsert(spark, root, frame(("b", "B2", 9, 9), ("c", "C", 3, 9)), ["email"])
    (tmp_path / "t" / "version=9").mkdir()
    assert rows_of(tables.latest_snapshot(spark, root)) == [
        ("a", "A", 1, 1), ("b", "B2", 2, 1), ("c", "C", 3, 9)]
    assert tables.scan(spark, f"{root}/version=1").count() == 2


def test_live_progress_over_batches(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "log")
    schema = "id int, workload_id string, status string, changed_at timestamp"

    def arrive(*changes):
        frame = spark.createDataFrame([(i, w, s, None) for i, w, s, _ in changes], schema)
        times = spark.createDataFrame([(i, s, t) for i, _, s, t in changes],
                                      "id int, status string, t string")
        (frame.drop("changed_at").join(times, ["id", "status"])
         .withColumn("changed_at", F.col("t").cast("timestamp")).drop("t")
         .write.mode("append").parquet(str(source)))
        stream = spark.readStream.schema(schema).parquet(str(source))
        live.start_status_log(stream, root, str(tmp_path / "check")).awaitTermination()
        work = spark.createDataFrame([("w", 2)], "id string, total_items long")
        return live.live_progress(spark, root, work).first()

    first = arrive((1, "w", "running", "2024-01-01 00:00:01"),
                   (1, "w", "queued", "2024-01-01 00:00:00"))
    assert (first.status, first.running_items, first.queued_items) == ("running", 1, 0)
    second = arrive((1, "w", "succeeded", "2024-01-01 00:00:05"),
                    (2, "w", "dead_letter", "2024-01-01 00:00:06"))
    assert (second.status, second.percent) == ("failed", 100)
    late = arrive((1, "w", "running", "2024-01-01 00:00:02"))
    assert late.completed_items == 1


def test_folded_status_log_reads_the_same(spark, tmp_path):
    root = str(tmp_path)
    store = Store(spark, root)
    schema = "id int, workload_id string, status string, changed_at string, change_seq bigint"

    def arrive(n, *changes):
        rows = spark.createDataFrame([(*c, n) for c in changes], schema)
        store.apply(lambda b: b.append(live.STATUSES, rows), live.STATUSES, n)

    for n in range(6):
        arrive(n, (n, "w", "queued", "01"), (1, "w", "running", f"0{n}"))
        if n in (2, 4):
            live.fold_statuses(spark, root)
            assert len(store.state().logs[live.STATUSES]["paths"]) == 1
    assert len(store.state().logs[live.STATUSES]["paths"]) == 2
    # A change older than the folded one, and a replayed batch, move nothing.
    arrive(6, (1, "w", "queued", "02"))
    arrive(3, (1, "w", "failed", "99"))
    found = {r.id: r.status for r in live.latest_statuses(spark, root).collect()}
    assert found == {0: "queued", 1: "running", 2: "queued", 3: "queued", 4: "queued", 5: "queued"}
    store.expire(keep=1)
    assert len(list((tmp_path / live.STATUSES).iterdir())) == 3
    assert live.latest_statuses(spark, root).count() == 6


def test_changes_of_one_time_in_two_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "id int, workload_id string, status string, changed_at timestamp"
    time = F.lit("2024-01-01 00:00:01").cast("timestamp")
    for status in ("running", "queued"):
        (spark.createDataFrame([(1, "w", status)], "id int, workload_id string, status string")
         .withColumn("changed_at", time).write.mode("append").parquet(source))
        stream = spark.readStream.schema(schema).parquet(source)
        live.start_status_log(stream, root, str(tmp_path / "check")).awaitTermination()
    assert [r.status for r in live.latest_statuses(spark, root).collect()] == ["running"]
    live.fold_statuses(spark, root)
    assert [r.status for r in live.latest_statuses(spark, root).collect()] == ["running"]


def test_progress_as_state_equals_counting_the_newest_statuses(spark, tmp_path):
    import random
    source, root, rng = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(2)
    names = ["queued", "running", "succeeded", "failed", "retrying", "dead_letter", "cancelled"]
    newest = {}

    def arrive(rows):
        for job, work, status, at in rows:
            newest[job] = max(newest.get(job, ("", "", "")), (at, status, work))
        frame = spark.createDataFrame(rows, "id int, workload_id string, status string, at string")
        (frame.withColumn("changed_at", F.col("at").cast("timestamp")).drop("at").coalesce(1)
         .write.mode("append").parquet(source))
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        live.start_progress(stream, root, str(tmp_path / "check")).awaitTermination()
        found = {r.workload_id: tuple(r)[1:] for r in live.read_progress(spark, root).collect()}
        jobs = spark.createDataFrame([(w, s) for _, s, w in newest.values()],
                                     "workload_id string, status string")
        counted = {r.workload_id: tuple(r)[1:] for r in status_counts(jobs).collect()}
        assert {w: c for w, c in found.items() if any(c)} == counted
        return found

    def change(at):
        job = rng.randint(0, 40)
        return (job, "hot" if job % 3 else f"w{job % 6}", rng.choice(names), at)

    arrive([change(f"2024-01-01 00:00:{rng.randint(10, 59)}") for _ in range(60)])
    live.fold_progress(spark, root)
    before = arrive([change("2024-01-01 00:01:00") for _ in range(10)])
    # Late changes move no job back.
    known = list(newest)
    assert arrive([(j, newest[j][2], "queued", "2023-01-01 00:00:00") for j in known]) == before
    # A job that moves to another workload leaves the first one.
    moved = arrive([(known[0], "elsewhere", "running", "2025-01-01 00:00:00")])
    assert moved["elsewhere"] == (0, 1, 0, 0, 0, 0)


def test_progress_costs_no_python_per_job(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    jobs = F.col("id").cast("string")
    for low, status in ((0, "queued"), (200_000, "running")):
        # The second batch moves a third of the jobs and brings two thirds; one has no id.
        (spark.range(low, low + 300_000).select(
            F.when(F.col("id") > 0, jobs).alias("id"), F.lit("w").alias("workload_id"),
            F.lit(status).alias("status"), F.lit(f"2024-01-0{1 + low // 200_000}").cast("timestamp")
            .alias("changed_at")).write.mode("append").parquet(source))
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = live.start_progress(stream, root, str(tmp_path / "check"))
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
    found = live.read_progress(spark, root).collect()
    assert [tuple(r)[:3] for r in found] == [("w", 200_000, 300_000)]


def test_retry_release_skips_cancelled_jobs(spark, tmp_path):
    root = str(tmp_path)
    policy = F.struct(F.lit(1000).alias("initial_backoff_ms"), F.lit(60000).alias("max_backoff_ms"),
                      F.lit(2.0).alias("backoff_multiplier"))
    jobs = spark.createDataFrame([(1, "retrying"), (2, "retrying"), (3, "failed")],
                                 "id int, status string").select(
        "*", F.lit(1).alias("attempt_count"), policy.alias("retry_policy"),
        *[F.lit("2024-01-01 00:00:00").cast("timestamp").alias(c)
          for c in ("created_at", "updated_at")])
    tables.append_changes(jobs, root, 0)
    tables.append_changes(jobs.filter("id = 2").withColumn("status", F.lit("cancelled")), root, 1)
    now = F.lit("2024-01-01 00:00:01").cast("timestamp")
    assert due_retries(jobs, now).count() == 2
    for _ in range(2):
        live.release_due_retries(spark, root, now, 2)
    state = tables.current_rows(tables.read_changes(spark, root), ["id"])
    assert {r.id: r.status for r in state.collect()} == {1: "queued", 2: "cancelled", 3: "failed"}


def test_retry_timers(spark, tmp_path):
    import time

    from sluice.streaming.timers import start_retry_timers
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    policy = F.struct(F.col("wait").alias("initial_backoff_ms"),
                      F.lit(10**9).alias("max_backoff_ms"), F.lit(2.0).alias("backoff_multiplier"))

    def arrive(*rows):
        frame = spark.createDataFrame(list(rows), "id long, status string, wait long, ago int")
        frame.select("id", "status", F.lit(1).alias("attempt_count"),
                     (F.current_timestamp() - F.make_dt_interval(secs=F.col("ago")))
                     .alias("updated_at"), policy.alias("retry_policy")
                     ).coalesce(1).write.mode("append").parquet(source)

    # 1 is due, 2 soon, 3 far away, 4 soon but cancelled, 5 never retrying.
    arrive((1, "retrying", 1000, 60), (2, "retrying", 12000, 0), (3, "retrying", 10**8, 0),
           (4, "retrying", 12000, 0), (4, "cancelled", 0, -1), (5, "queued", 0, 0))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = start_retry_timers(stream, root, str(tmp_path / "check"))
    try:
        deadline = time.time() + 60
        seen = set()
        while seen != {1, 2} and time.time() < deadline and query.isActive:
            time.sleep(1)
            if list(tmp_path.glob("out/batch_id=*/_SUCCESS")):
                seen = {r.id for r in tables.read_changes(spark, root).collect()}
        assert seen == {1, 2}, query.exception()
        row = tables.read_changes(spark, root).filter("id = 2").first()
        assert row.released_ms >= row.due_ms
    finally:
        query.stop()
