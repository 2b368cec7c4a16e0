"""Queries over hierarchies, jobs, progress, metrics, paging and workflows."""

from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.catalog import shapes
from sluice.catalog.base import query, sql
from sluice.catalog.functions import LOW, SLUG, UP
from sluice.catalog.sources import ORACLE_LINES, quoted
from sluice.operators import hierarchy, jobs, metrics, paging, progress, workflows
from sluice.operators.skew import lookup, number_rows
from sluice.plans.handlers import HandlerRegistry, as_result, builtin_registry, uppercase
from sluice.plans.targets import PRODUCTS
from sluice.sources import csv, ocr

# -------------------------------------------------------------- hierarchies


def tree(t, shape):
    return t.shape(shape).select(fn.slugify(F.col("name")).alias("slug"),
                                 fn.slugify(F.col("parent")).alias("parent_slug"))


def tree_sql(shape):
    return (f"SELECT {SLUG.format('name')} AS slug, {SLUG.format('parent')} AS parent_slug "
            f"FROM ({sql(shape)})")


def walk_sql(table, walk):
    """Step-by-step walk of every row's parents in ``table``."""
    return f"""
{walk} AS (SELECT slug, parent_slug, parent_slug AS cur, 0 AS d, [slug] AS visited,
    CASE WHEN parent_slug IS NULL THEN 'ok' END AS outcome, CAST(NULL AS VARCHAR) AS culprit,
    0 AS depth FROM {table}
  UNION ALL
  SELECT w.slug, w.parent_slug, p.parent_slug, w.d + 1, list_append(w.visited, w.cur),
    CASE WHEN list_contains(w.visited, w.cur) THEN 'cycle' WHEN w.d > 64 THEN 'too_deep'
      WHEN p.slug IS NULL THEN 'missing' WHEN p.parent_slug IS NULL THEN 'ok' END,
    CASE WHEN list_contains(w.visited, w.cur) OR (w.d <= 64 AND p.slug IS NULL) THEN w.cur END,
    w.d + 1
  FROM {walk} w LEFT JOIN {table} p ON p.slug = w.cur WHERE w.outcome IS NULL)"""


VERDICT = "slug, outcome, culprit, CASE WHEN outcome = 'ok' THEN depth END AS depth"


@query("jn2_parent_chain_check", f"""
WITH RECURSIVE tree AS MATERIALIZED ({tree_sql(shapes.TREE)}), {walk_sql('tree', 'walk')}
SELECT {VERDICT} FROM walk WHERE outcome IS NOT NULL""")
def _(t):
    return hierarchy.parent_chain_check(tree(t, shapes.TREE)).drop("parent_slug")


@query("jn4_hierarchy_resolve", f"""
WITH RECURSIVE stored AS MATERIALIZED ({tree_sql(shapes.STORED_TREE)}),
accepted AS MATERIALIZED ({tree_sql(shapes.ACCEPTED_TREE)}),
tree AS MATERIALIZED (SELECT * FROM accepted UNION ALL
  SELECT * FROM stored WHERE slug NOT IN (SELECT slug FROM accepted)),
{walk_sql('tree', 'walk')},
withdrawn AS MATERIALIZED (SELECT * FROM walk WHERE outcome <> 'ok'
  AND slug IN (SELECT slug FROM accepted) AND slug IN (SELECT slug FROM stored)),
tree2 AS MATERIALIZED (SELECT * FROM accepted WHERE slug NOT IN (SELECT slug FROM withdrawn)
  UNION ALL SELECT * FROM stored WHERE slug NOT IN (SELECT slug FROM accepted)
    OR slug IN (SELECT slug FROM withdrawn)),
{walk_sql('tree2', 'walk2')}
SELECT {VERDICT} FROM withdrawn UNION ALL SELECT {VERDICT} FROM walk2 WHERE outcome IS NOT NULL
  AND slug IN (SELECT slug FROM accepted) AND slug NOT IN (SELECT slug FROM withdrawn)""")
def _(t):
    return hierarchy.hierarchy_resolve(tree(t, shapes.STORED_TREE),
                                       tree(t, shapes.ACCEPTED_TREE)).drop("parent_slug")


@query("jn10_children_of", f"""
SELECT parent_slug, count(*) AS children FROM ({tree_sql(shapes.TREE)})
WHERE parent_slug IS NOT NULL GROUP BY 1""")
def _(t):
    return hierarchy.children_of(tree(t, shapes.TREE))


# -------------------------------------------------------------------- joins

@query("jn1_key_lookup", """
SELECT event_id, c_custkey IS NOT NULL AS found, c_name FROM events
LEFT JOIN customer ON c_custkey = user_id * 20""")
def _(t):
    wanted = t["events"].select("event_id", (F.col("user_id") * 20).alias("key"))
    users = t["customer"].select(F.col("c_custkey").alias("key"), "c_name",
                                 F.lit(True).alias("_found"))
    return lookup(wanted, users, ["key"], spread=["event_id"]).select(
        "event_id", F.coalesce("_found", F.lit(False)).alias("found"), "c_name")


LINK = """CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 0
  ELSE l_orderkey END"""


@query("jn5_workload_jobs", f"""
SELECT l_linenumber, l_partkey, l_suppkey, workload_id, o_orderpriority AS workload_type,
  o_orderkey % 7 AS total_items
FROM (SELECT *, {LINK} AS workload_id FROM lineitem) LEFT JOIN orders ON o_orderkey = workload_id
""")
def _(t):
    lines = t["lineitem"].select("l_linenumber", "l_partkey", "l_suppkey",
                                 F.expr(LINK).alias("workload_id"),
                                 F.xxhash64("l_orderkey", "l_partkey").alias("id"))
    return progress.workload_jobs(t.shape(shapes.ORDER_WORKLOADS), lines).drop("id")


@query("jn6_job_attempts", f"""
SELECT attempt_id, job_id, attempt_number, outcome, status FROM (SELECT *, row_number() OVER (
  PARTITION BY job_id ORDER BY started_at, attempt_id) AS attempt_number
  FROM ({shapes.ORACLE_ATTEMPTS})) LEFT JOIN ({shapes.ORACLE_CUSTOMER_JOBS}) j ON j.id = job_id""")
def _(t):
    attempts = jobs.number_attempts(t.shape(shapes.SPARK_ATTEMPTS))
    owners = t.shape(shapes.SPARK_CUSTOMER_JOBS).withColumn("job_type", F.lit("x"))
    return jobs.job_attempts(owners, attempts).select("attempt_id", "job_id", "attempt_number",
                                                      "outcome", "status")


@query("jn7_provenance", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS workload_id,
  o_orderstatus AS job_status, c_mktsegment AS workload_type FROM lineitem
LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def _(t):
    records = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   F.col("l_orderkey").alias("job_id"))
    job_rows = t["orders"].select(F.col("o_orderkey").alias("id"),
                                  F.col("o_custkey").alias("workload_id"),
                                  F.col("o_orderstatus").alias("status"))
    workload_rows = t["customer"].select(F.col("c_custkey").alias("id"),
                                         F.col("c_mktsegment").alias("type"))
    return progress.provenance(records, job_rows, workload_rows, "l_partkey").drop("job_id")


def _workflows(t, position):
    """Conversations as workflows; each turn is a step."""
    turns = t["conversations"]
    number = F.col("conv_id") * 1000 + F.col("turn")
    steps = turns.select(number.alias("id"), F.col("conv_id").alias("workflow_id"),
                         number.alias("job_id"), F.col("role").alias("name"),
                         F.col("turn").alias(position))
    edges = turns.filter(F.col("turn") > 0).select(
        number.alias("step_id"), (number - 1).alias("depends_on_step_id"))
    return turns.select(F.col("conv_id").alias("id")).distinct(), steps, edges


@query("jn8_workflow_assemble", """
SELECT conv_id AS id, string_agg(turn || ':' || role || '<' || CASE WHEN turn > 0 THEN
  CAST(conv_id * 1000 + turn - 1 AS VARCHAR) ELSE '' END, ' ' ORDER BY turn) AS steps
FROM conversations GROUP BY conv_id""")
def _(t):
    text = F.transform("steps", lambda s: F.concat(
        s["position"].cast("string"), F.lit(":"), s["name"], F.lit("<"),
        F.array_join(s["depends_on"].cast("array<string>"), ",")))
    return workflows.workflow_documents(*_workflows(t, "position")).select(
        "id", F.array_join(text, " ").alias("steps"))


@query("jn8_workflow_steps", """
SELECT o_orderkey % 5 AS workflow_id, o_orderkey AS step_id, o_orderstatus AS name,
  o_orderkey % 4 AS dependencies FROM orders""")
def _(t):
    # Five workflows hold all orders; an order depends on up to three before it.
    key = F.col("o_orderkey")
    steps = t["orders"].select(key.alias("id"), (key % 5).alias("workflow_id"),
                               key.alias("job_id"), F.col("o_orderstatus").alias("name"),
                               key.alias("position"))
    edges = (t["orders"].filter(key % 4 > 0)
             .select(key.alias("step_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), key % 4))
                     .alias("back"))
             .select("step_id", (F.col("step_id") - F.col("back")).alias("depends_on_step_id")))
    flows = steps.select(F.col("workflow_id").alias("id")).distinct()
    counted = workflows.step_dependencies(flows, steps, edges).groupBy("step_id").agg(
        F.count(F.lit(1)).alias("dependencies"))
    return (workflows.workflow_steps(flows, steps).join(counted, "step_id", "left")
            .select("workflow_id", "step_id", "name",
                    F.coalesce("dependencies", F.lit(0).cast("bigint")).alias("dependencies")))


@query("jn9_due_retry_recheck", f"""
SELECT id FROM ({sql(shapes.ORDER_JOBS)}) WHERE status = 'retrying' AND queue_name <> '1-URGENT'""")
def _(t):
    rows = t.shape(shapes.ORDER_JOBS)
    status = F.when(F.col("queue_name") == "1-URGENT", "cancelled").otherwise(F.col("status"))
    candidates = rows.filter(F.col("status") == "retrying").select("id")
    return jobs.still_retrying(candidates, rows.select("id", status.alias("status")))


# -------------------------------------------------------------- aggregations

@query("agg1_workload_progress", f"""
WITH jobs AS ({sql(shapes.LINE_JOBS)}), counted AS (SELECT id, type, total_items,
  count(*) FILTER (WHERE status IN ('queued', 'retrying')) AS queued_items,
  count(*) FILTER (WHERE status = 'running') AS running_items,
  count(*) FILTER (WHERE status = 'succeeded') AS completed_items,
  count(*) FILTER (WHERE status IN ('failed', 'dead_letter')) AS failed_items,
  count(*) FILTER (WHERE status = 'retrying') AS retrying_items,
  count(*) FILTER (WHERE status = 'dead_letter') AS dead_letter_items
  FROM ({sql(shapes.ORDER_WORKLOADS)}) LEFT JOIN jobs ON workload_id = id GROUP BY ALL)
SELECT *, CASE WHEN total_items = 0 THEN 'succeeded'
    WHEN completed_items + failed_items < total_items THEN 'running'
    WHEN failed_items > 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN total_items = 0 THEN 100 ELSE CAST(floor(100.0 * (completed_items + failed_items)
    / total_items + 0.5) AS BIGINT) END AS percent FROM counted""")
def _(t):
    return progress.workload_progress(t.shape(shapes.ORDER_WORKLOADS), t.shape(shapes.LINE_JOBS))


@query("agg2_table_count", "SELECT count(*) AS total FROM lineitem")
def _(t):
    return progress.table_count(t["lineitem"])


SAMPLES = sql(shapes.METRICS)


@query("agg4_counter_sum", f"""
SELECT name, CAST(sum(value) AS BIGINT) AS value FROM ({SAMPLES}) WHERE kind = 'counter'
GROUP BY 1""")
def _(t):
    return metrics.counter_sum(t.shape(shapes.METRICS))


@query("agg5_gauge_last", f"""
SELECT name, arg_max(value, (ts, event_id)) AS value FROM ({SAMPLES}) WHERE kind = 'gauge'
GROUP BY 1""")
def _(t):
    return metrics.gauge_last(t.shape(shapes.METRICS), ("ts", "event_id"))


@query("agg6_histogram_stats", f"""
SELECT name, count(*) AS count, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min,
  max(value) AS max FROM ({SAMPLES}) WHERE kind = 'histogram' GROUP BY 1""")
def _(t):
    return metrics.histogram_stats(t.shape(shapes.METRICS))


@query("agg7_metrics_render", f"""
WITH h AS (SELECT name, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi
  FROM ({SAMPLES}) WHERE kind = 'histogram' GROUP BY 1)
SELECT 1 AS section, name AS family, 0 AS part, name, CAST(sum(value) AS DOUBLE) AS value
  FROM ({SAMPLES}) WHERE kind = 'counter' GROUP BY name
UNION ALL SELECT 2, name, 0, name, CAST(arg_max(value, (ts, event_id)) AS DOUBLE)
  FROM ({SAMPLES}) WHERE kind = 'gauge' GROUP BY name
UNION ALL SELECT 3, name, 0, name || '_count', CAST(n AS DOUBLE) FROM h
UNION ALL SELECT 3, name, 1, name || '_sum', CAST(s AS DOUBLE) FROM h
UNION ALL SELECT 3, name, 2, name || '_min', CAST(lo AS DOUBLE) FROM h
UNION ALL SELECT 3, name, 3, name || '_max', CAST(hi AS DOUBLE) FROM h""")
def _(t):
    return metrics.metrics_render(t.shape(shapes.METRICS), ("ts", "event_id"))


NUMBERED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at,
  attempt_id) AS attempt_number FROM ({shapes.ORACLE_ATTEMPTS}))"""


@query("agg8_attempt_outcomes", f"""
SELECT CASE WHEN outcome = 'failed' AND retryable THEN CASE WHEN attempt_number >= 40
    THEN 'dead_letter' ELSE 'retrying' END ELSE outcome END AS result, count(*) AS attempts,
  CAST(sum(epoch_ms(finished_at - started_at)) AS BIGINT) AS total_ms,
  min(epoch_ms(finished_at - started_at)) AS min_ms,
  max(epoch_ms(finished_at - started_at)) AS max_ms FROM {NUMBERED_SQL} GROUP BY 1""")
def _(t):
    attempts = jobs.number_attempts(t.shape(shapes.SPARK_ATTEMPTS))
    return progress.attempt_outcomes(attempts.withColumn("max_attempts", F.lit(40)))


@query("agg8_attempt_counters", f"""
WITH finished AS (SELECT CASE WHEN outcome = 'failed' AND retryable THEN CASE
    WHEN attempt_number >= 40 THEN 'dead_letter' ELSE 'retrying' END ELSE outcome END AS result,
  epoch_ms(finished_at - started_at) AS ms FROM {NUMBERED_SQL} WHERE attempt_id % 10 <> 0)
SELECT result, count(*) AS attempts, CAST(sum(ms) AS BIGINT) AS total_ms, min(ms) AS min_ms,
  max(ms) AS max_ms FROM finished GROUP BY 1
UNION ALL SELECT 'started', (SELECT count(*) FROM events), CAST(sum(ms) AS BIGINT), min(ms), max(ms)
FROM finished""")
def _(t):
    attempts = jobs.number_attempts(t.shape(shapes.SPARK_ATTEMPTS)).withColumns({
        "max_attempts": F.lit(40),
        "outcome": F.when(F.col("attempt_id") % 10 != 0, F.col("outcome"))})
    return progress.attempt_counters(attempts)


# ------------------------------------------------------------ rows in order

@query("win3_row_numbering", """
SELECT CAST(doc_id AS VARCHAR) AS submission_id, row_number() OVER (PARTITION BY doc_id
  ORDER BY pos) AS row_index, md5(line) AS line FROM (SELECT doc_id,
  unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE line <> ''""")
def _(t):
    lines = F.transform(F.split("text", "\n"), quoted)
    files = t["documents"].select(
        F.col("doc_id").cast("string").alias("submission_id"),
        F.encode(F.concat(F.lit("\r\nline\r\n\r\n"), F.array_join(lines, "\r\n\n")),
                 "UTF-8").alias("content"))
    rows = csv.data_rows(csv.csv_file_admission(files))
    return rows.select("submission_id", "row_index",
                       F.md5(F.element_at("fields", 1)).alias("line"))


@query("win4_index_remap", """
SELECT user_id AS submission_id, event_id AS row_index, row_number() OVER (PARTITION BY user_id
  ORDER BY event_id) AS position FROM events WHERE event_type <> 'error'""")
def _(t):
    surviving = t["events"].filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("submission_id"), F.col("event_id").alias("row_index"))
    return number_rows(surviving, ["submission_id"], F.floor(F.col("row_index") / 1_000_000),
                       [F.col("row_index")], "position")


@query("win5_column_gaps", f"""{ORACLE_LINES}
SELECT submission_id, line_num, max(col) + 1 AS columns, count(*) AS words FROM cols GROUP BY ALL
""")
def _(t):
    words = t.shape(shapes.SPARK_WORDS)
    lines = ocr.column_starts(words, ocr.image_figures(words), texts=False)
    return lines.select("submission_id", "line_num", F.size("starts").cast("bigint")
                        .alias("columns"), F.size("words").cast("bigint").alias("words"))


@query("win6_attempt_number", f"SELECT attempt_id, job_id, attempt_number FROM {NUMBERED_SQL}")
def _(t):
    return jobs.number_attempts(t.shape(shapes.SPARK_ATTEMPTS)).select(
        "attempt_id", "job_id", "attempt_number")


@query("srt1_page", """
SELECT o_orderkey AS id, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders
ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 200""")
def _(t):
    table = t["orders"].select(F.col("o_orderkey").alias("id"), "o_orderstatus",
                               F.col("o_orderdate").alias("created_at"))
    return paging.page_with_total(table, paging.clamp_job_limit(50), 200).drop("created_at")


@query("srt2_priority_order", f"""
SELECT queue_name, id, turn FROM (SELECT *, row_number() OVER (PARTITION BY queue_name
  ORDER BY priority DESC, created_at, id) AS turn FROM (
  SELECT * REPLACE (CAST(attempt_count AS INT) AS priority) FROM ({sql(shapes.ORDER_JOBS)})))
WHERE turn <= 25""")
def _(t):
    rows = t.shape(shapes.ORDER_JOBS).withColumn("priority", F.col("attempt_count"))
    return jobs.next_of_queue(rows, 25).select("queue_name", "id", "turn")


@query("srt2_priority_list", f"""
SELECT id, priority FROM ({sql(shapes.ORDER_JOBS)}) ORDER BY priority DESC, created_at, id""")
def _(t):
    return jobs.priority_order(t.shape(shapes.ORDER_JOBS)).select("id", "priority")


@query("srt3_admit_by_capacity", f"""
SELECT id, turn <= 100 AS admitted, CASE WHEN turn > 100 THEN 'scheduler queue is at capacity' END
  AS reason FROM (SELECT id, row_number() OVER (PARTITION BY queue_name ORDER BY created_at, id)
  AS turn FROM ({sql(shapes.ORDER_JOBS)}))""")
def _(t):
    return jobs.admit_by_capacity(t.shape(shapes.ORDER_JOBS), 100).select("id", "admitted",
                                                                          "reason")


@query("srt4_status_batch", f"""
SELECT id, queue_name FROM ({sql(shapes.ORDER_JOBS)}) WHERE status = 'queued'
ORDER BY updated_at, id LIMIT 50""")
def _(t):
    return jobs.status_batch(t.shape(shapes.ORDER_JOBS), "queued", 50).select("id", "queue_name")


def retry_jobs(t):
    return t["events"].select(
        F.col("event_id").alias("id"), F.col("ts").alias("updated_at"),
        F.when(F.col("event_type") == "error", "retrying").otherwise("queued").alias("status"),
        (F.col("user_id") % 7).alias("attempt_count"), F.struct(
            F.lit(3600000).alias("initial_backoff_ms"), F.lit(86400000).alias("max_backoff_ms"),
            F.lit(2.0).alias("backoff_multiplier")).alias("retry_policy"))


DUE_SQL = """SELECT event_id AS id FROM events WHERE event_type = 'error' AND
  ts + to_milliseconds(CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(least(3600000 *
  pow(2, user_id % 7 - 1), 86400000) AS BIGINT) END) <= TIMESTAMP '2024-01-15 12:00:00'"""


@query("srt5_due_retries", DUE_SQL + " ORDER BY ts, event_id LIMIT 50")
def _(t):
    return jobs.due_retries(retry_jobs(t), F.lit("2024-01-15 12:00:00").cast("timestamp"),
                            50).select("id")


@query("srt5_due_retries_all", DUE_SQL)
def _(t):
    return jobs.due_retries(retry_jobs(t), F.lit("2024-01-15 12:00:00").cast("timestamp"),
                            None).select("id")


@query("srt6_ordered_children", """
SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS steps FROM conversations
ORDER BY conv_id, turn""")
def _(t):
    sizes = t["conversations"].groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"))
    steps = t["conversations"].select("conv_id", "turn", "role")
    return lookup(steps, sizes, ["conv_id"], spread=["turn"]).orderBy("conv_id", "turn")


@query("snk6_api_documents", f"""
SELECT CAST(json_object('id', id, 'queue_name', queue_name, 'status', status, 'last_error', NULL,
  'created_at', strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z')) AS VARCHAR) AS document
FROM ({sql(shapes.ORDER_JOBS)})""")
def _(t):
    rows = t.shape(shapes.ORDER_JOBS)
    return rows.select(paging.json_document(
        "id", "queue_name", "status", F.lit(None).cast("string").alias("last_error"),
        fn.to_iso8601(F.col("created_at")).alias("created_at")).alias("document"))


@query("snk6_page_envelope", """
SELECT (SELECT count(*) FROM customer) AS total, 50 AS size, 50 AS "limit", 100 AS "offset",
  (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 100) AS first""")
def _(t):
    users = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                 F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    document = paging.record_document(["id", "name", "created_at"])
    page = paging.envelope(users, document, "users", 50, 100)
    read = lambda p: F.get_json_object("document", p)
    return page.select(
        read("$.total").cast("bigint").alias("total"),
        F.json_array_length(read("$.users")).cast("bigint").alias("size"),
        read("$.limit").cast("bigint").alias("limit"),
        read("$.offset").cast("bigint").alias("offset"),
        read("$.users[0].name").alias("first"))


# ------------------------------------------------------------ job processing

@query("udf1_handler_registry", f"""
SELECT doc_id AS id, CASE WHEN lang IN ('en', 'fr') THEN 'succeeded' ELSE 'failed' END AS status,
  md5(CASE lang WHEN 'en' THEN translate(text, '{LOW}', '{UP}') WHEN 'fr' THEN text END) AS output,
  CASE WHEN lang NOT IN ('en', 'fr') THEN 'no handler registered for job type ''' || lang || ''''
  END AS error FROM documents""")
def _(t):
    registry = HandlerRegistry()
    registry.register("en", uppercase)
    registry.register("fr", lambda rows: as_result(rows.select(
        "id", F.col("payload").alias("output"), F.lit(None).cast("string").alias("reason"))))
    rows = t["documents"].select(F.col("doc_id").alias("id"), F.col("lang").alias("job_type"),
                                 F.col("text").alias("payload"))
    return registry.run(rows).select("id", "status", F.md5("output").alias("output"), "error")


@query("udf2_record_handlers", """
SELECT p_partkey AS id, CASE WHEN p_size > 3 AND p_brand <> 'Brand#5' THEN 'succeeded'
  ELSE 'failed' END AS status, CASE WHEN p_size > 3 AND p_brand <> 'Brand#5' THEN 'P-' || p_partkey
  END AS sku, CASE WHEN p_size <= 3 THEN '''price'' is required and must be a JSON string'
  WHEN p_brand = 'Brand#5' THEN '''price'' must be between 0 and 10000000.000000' END AS error
FROM part""")
def _(t):
    price = F.when(F.col("p_brand") == "Brand#5", "-1").otherwise("2.50")
    payload = fn.payload_json(F.concat(F.lit("p-"), "p_partkey").alias("sku"),
                              F.col("p_name").alias("name"),
                              F.when(F.col("p_size") > 3, price).alias("price"))
    rows = t["part"].select(F.col("p_partkey").alias("id"), payload.alias("payload"),
                            F.lit(PRODUCTS.job_type).alias("job_type"),
                            F.lit(0).alias("created_at"))
    none = t.spark.createDataFrame([], "slug string, parent_slug string")
    result = builtin_registry(none).resolve(PRODUCTS.job_type)(rows)
    return result.select("id", "status", F.get_json_object("output", "$.sku").alias("sku"),
                         "error")


APPLY_SQL = f"""
WITH jobs AS ({shapes.ORACLE_CUSTOMER_JOBS}), attempts AS {NUMBERED_SQL},
live AS (SELECT a.*, greatest(j.max_attempts - j.attempt_count, 1) AS allowed FROM attempts a
  JOIN jobs j ON j.id = a.job_id WHERE j.status NOT IN ('succeeded', 'cancelled', 'dead_letter')),
marked AS (SELECT *, outcome IN ('succeeded', 'cancelled')
  OR (outcome = 'failed' AND retryable AND attempt_number >= allowed) AS ends FROM live),
used AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY job_id
  ORDER BY attempt_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM marked),
folded AS (SELECT job_id, count(*) FILTER (WHERE outcome <> 'cancelled') AS tried,
  arg_max(CASE WHEN outcome <> 'failed' THEN CASE outcome WHEN 'timed_out' THEN 'failed'
    ELSE outcome END WHEN NOT retryable THEN 'failed' WHEN ends THEN 'dead_letter'
    ELSE 'retrying' END, attempt_number) AS status,
  arg_max(error_message, attempt_number) FILTER (WHERE outcome IN ('failed', 'timed_out')) AS error,
  arg_max(finished_at, attempt_number) AS finished_at FROM used WHERE ended = 0 GROUP BY 1)
SELECT id, max_attempts, coalesce(f.status, j.status) AS status,
  CAST(attempt_count + coalesce(tried, 0) AS BIGINT) AS attempt_count,
  coalesce(error, last_error) AS last_error,
  strftime(coalesce(finished_at, updated_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM jobs j LEFT JOIN folded f ON f.job_id = j.id"""


@query("udf3_apply_attempts", APPLY_SQL)
def _(t):
    done = jobs.apply_attempts(t.shape(shapes.SPARK_CUSTOMER_JOBS), t.shape(shapes.SPARK_ATTEMPTS))
    return done.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("val13_commands", f"""
SELECT event_id AS command_id, event_type AS command, CASE WHEN id IS NULL THEN 'not_found'
  WHEN status IN ('succeeded', 'cancelled', 'dead_letter') THEN 'conflict' ELSE 'applied' END
  AS outcome, CASE WHEN status NOT IN ('succeeded', 'cancelled', 'dead_letter') THEN
  CASE event_type WHEN 'error' THEN 'cancelled' ELSE 'queued' END ELSE status END AS new_status
FROM events LEFT JOIN ({sql(shapes.ORDER_JOBS)}) ON id = user_id * user_id""")
def _(t):
    commands = t["events"].select(
        F.col("event_id").alias("command_id"), F.col("event_type"),
        F.when(F.col("event_type") == "error", "cancel").otherwise("queue").alias("command"),
        (F.col("user_id") * F.col("user_id")).alias("job_id"))
    done = jobs.apply_commands(commands, t.shape(shapes.ORDER_JOBS))
    return done.select("command_id", F.col("event_type").alias("command"), "outcome",
                       "new_status")
