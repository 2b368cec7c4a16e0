"""Queries that run a Structured Streaming job to its end and read its output."""

from pyspark.sql import functions as F

from sluice.catalog import shapes
from sluice.catalog.base import query, sql
from sluice.catalog.records import PRODUCTS_CTE
from sluice.lineage import fresh_path
from sluice.plans.targets import PRODUCTS
from sluice.sources.store import Store
from sluice.sources.tables import append_changes, current_rows, read_changes
from sluice.streaming import ingest, live


def stream(t, name):
    """A given table as a file stream."""
    return (t.spark.readStream.schema(t[name].schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(t.folder))


@query("str1_continuous_ingest", f"""{PRODUCTS_CTE}
SELECT sku, arg_max(name, (submission_id, row_index)) AS name, CAST(arg_max(
  CAST(price AS DECIMAL(12,2)), (submission_id, row_index)) AS DOUBLE) AS price,
  arg_max(coalesce(stock, 0), (submission_id, row_index)) AS stock_quantity
FROM final WHERE reason IS NULL GROUP BY 1""")
def _(t):
    root = fresh_path(t.spark, "ingest")
    rows = t.spark.sql(shapes.PRODUCTS, part=stream(t, "part"))
    ingest.start_record_ingest(rows, PRODUCTS, root, f"{root}-checkpoint").awaitTermination()
    table = Store(t.spark, root).rows("products")
    return table.select("sku", "name", F.col("price").cast("double").alias("price"),
                        "stock_quantity")


CHANGES = f"""
SELECT l_orderkey || '-' || l_linenumber AS id, workload_id, status, l_shipdate AS changed_at
FROM (SELECT *, {shapes.LINE_JOBS.split('SELECT', 1)[1].rsplit('FROM', 1)[0]}
  FROM {{lineitem}})"""


PROGRESS_SQL = f"""
WITH latest AS (SELECT id, arg_max(status, (changed_at, status)) AS status, any_value(workload_id)
  AS workload_id FROM ({sql(CHANGES)}) GROUP BY 1)
SELECT workload_id AS id, count(*) FILTER (WHERE status IN ('queued', 'retrying')) AS queued_items,
  count(*) FILTER (WHERE status = 'running') AS running_items,
  count(*) FILTER (WHERE status = 'succeeded') AS completed_items,
  count(*) FILTER (WHERE status IN ('failed', 'dead_letter')) AS failed_items
FROM latest GROUP BY 1"""


def in_two_halves(t, name, first, run, fold):
    """A given table that arrives in two files; ``fold`` comes between their batches."""
    folder = fresh_path(t.spark, "arriving")
    rows = t[name]
    for number, part in enumerate((first, ~first)):
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)
        run(t.spark.readStream.schema(rows.schema).parquet(folder))
        if number == 0:
            fold()


@query("str2_live_progress", PROGRESS_SQL)
def _(t):
    root = fresh_path(t.spark, "status")

    def run(lines):
        changes = t.spark.sql(CHANGES, lineitem=lines)
        live.start_status_log(changes, root, f"{root}-checkpoint").awaitTermination()

    in_two_halves(t, "lineitem", F.col("l_partkey") % 2 == 0, run,
                  lambda: live.fold_statuses(t.spark, root))
    workloads = t["lineitem"].groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("total_items"))
    return live.live_progress(t.spark, root, workloads).select(
        "id", "queued_items", "running_items", "completed_items", "failed_items")


@query("str2_progress_state", PROGRESS_SQL)
def _(t):
    root = fresh_path(t.spark, "progress")

    def run(lines):
        changes = t.spark.sql(CHANGES, lineitem=lines)
        live.start_progress(changes, root, f"{root}-checkpoint").awaitTermination()

    in_two_halves(t, "lineitem", F.col("l_partkey") % 2 == 0, run,
                  lambda: live.fold_progress(t.spark, root))
    return live.read_progress(t.spark, root).select(
        F.col("workload_id").cast("bigint").alias("id"), "queued_items", "running_items",
        "completed_items", "failed_items")


@query("str3_retry_release", """
SELECT event_id AS id, CASE WHEN event_type = 'error' AND user_id % 7 > 3 THEN 'retrying'
  ELSE 'queued' END AS status FROM events""")
def _(t):
    root = fresh_path(t.spark, "retries")
    far = F.lit(10**15)
    jobs = t["events"].select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.when(F.col("event_type") == "error", "retrying").otherwise("queued").alias("status"),
        F.lit(2).alias("attempt_count"), F.struct(
            F.when(F.col("user_id") % 7 > 3, far).otherwise(F.lit(1000).cast("bigint"))
            .alias("initial_backoff_ms"), far.alias("max_backoff_ms"),
            F.lit(2.0).alias("backoff_multiplier")).alias("retry_policy"))
    append_changes(jobs, root, 0)
    live.start_retry_release(stream(t, "region"), root, f"{root}-checkpoint", 1,
                             availableNow=True).awaitTermination()
    return current_rows(read_changes(t.spark, root), ["id"]).select("id", "status")


@query("str4_metric_stream", f"""
SELECT name, kind, count(*) AS count, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min,
  max(value) AS max, arg_max(value, (ts, value)) AS last FROM ({sql(shapes.METRICS)}) GROUP BY 1, 2""")
def _(t):
    root = fresh_path(t.spark, "metrics")

    def run(events):
        samples = t.spark.sql(shapes.METRICS, events=events)
        live.start_metric_stream(samples, root, f"{root}-checkpoint").awaitTermination()

    in_two_halves(t, "events", F.col("user_id") % 2 == 0, run,
                  lambda: live.fold_metrics(t.spark, root))
    return live.read_metric_totals(t.spark, root)
