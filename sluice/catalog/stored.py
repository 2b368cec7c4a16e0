"""Queries that store what they confirm, and read it back from the versions they made."""

from pyspark.sql import functions as F

from sluice.catalog import shapes
from sluice.catalog.base import query, sql
from sluice.catalog.functions import SLUG, STABLE
from sluice.catalog.jobs import tree_sql, walk_sql
from sluice.catalog.records import CATEGORIES_CTE, PRODUCTS_CTE, USERS_CTE, as_maps
from sluice.lineage import fresh_path
from sluice.plans import run
from sluice.plans.targets import CATEGORIES, PRODUCTS, USERS
from sluice.sources.store import Store

DAYS = ("2024-02-01", "2024-02-02")


def imported(t, rows, target, first, columns=None):
    """Import ``rows`` in two batches, those that meet ``first`` before the others."""
    store = Store(t.spark, fresh_path(t.spark, "store"))
    records = as_maps(rows, {c: c for c in columns or target.columns})
    for day, part in zip(DAYS, (first, ~first)):
        run.import_records(store, records.filter(part), target, F.lit(day).cast("timestamp"))
    return store


def stable(*parts):
    return STABLE.format(" || chr(31) || ".join(parts))


def read_back(store, target, *values):
    """Stored rows with the job and workload they came from."""
    found = run.stored_provenance(store, target)
    return found.select(
        "id", target.key, *values, "job_id", "job_status", "workload_id", "workload_type",
        *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created_at", "updated_at")])


def stored_sql(accepted, target, key, values, batch):
    """Last write per key over two batches; ``accepted`` is what remains after duplicates."""
    job = stable(f"'{target.job_type}'", "submission_id", "row_index")
    lasting = ", ".join(f"arg_max({v}, (batch, job)) AS {n}" for n, v in values.items())
    return f""",
written AS (SELECT *, {batch} AS batch, {job} AS job,
  {stable(f"'{target.job_type}'", "submission_id")} AS work FROM ({accepted})),
kept AS (SELECT {key}, {lasting}, max_by(job, (batch, job)) AS job_id,
  max_by(work, (batch, job)) AS workload_id, min(batch) AS born, max(batch) AS changed
  FROM written GROUP BY {key})
SELECT {stable(f"'{target.name}'", key)} AS id, {key}, {", ".join(values)}, job_id,
  'succeeded' AS job_status, workload_id, '{target.job_type}' AS workload_type,
  CASE born WHEN 1 THEN '{DAYS[0]}' ELSE '{DAYS[1]}' END AS created_at,
  CASE changed WHEN 1 THEN '{DAYS[0]}' ELSE '{DAYS[1]}' END AS updated_at FROM kept"""


@query("udf2_run_products", PRODUCTS_CTE + stored_sql(
    "SELECT * FROM final WHERE reason IS NULL", PRODUCTS, "sku",
    {"name": "name", "price": "CAST(CAST(price AS DECIMAL(12,2)) AS DOUBLE)",
     "stock_quantity": "coalesce(stock, 0)", "description": "{'v': description}"},
    "1 + length(submission_id) % 2").replace("description, job_id,", "description.v AS description, job_id,"))
def _(t):
    store = imported(t, t.shape(shapes.PRODUCTS), PRODUCTS, F.length("submission_id") % 2 == 0)
    return read_back(store, PRODUCTS, "name", F.col("price").cast("double").alias("price"),
                     "stock_quantity", "description")


@query("udf2_run_users", USERS_CTE + stored_sql(
    "SELECT * FROM ranked WHERE reason IS NULL AND row_index = first_row", USERS, "email",
    {"name": "name", "phone": "{'v': phone}"}, "1 + length(submission_id) % 2")
    .replace("phone, job_id,", "phone.v AS phone, job_id,"))
def _(t):
    store = imported(t, t.shape(shapes.USERS), USERS, F.length("submission_id") % 2 == 0)
    return read_back(store, USERS, "name", "phone")


@query("udf2_run_categories", CATEGORIES_CTE + stored_sql(
    "SELECT * FROM ranked WHERE reason IS NULL AND nth = 1", CATEGORIES, "slug",
    {"name": "name", "parent_slug": "{'v': parent_slug}"},
    "CASE submission_id WHEN 'suppliers' THEN 2 ELSE 1 END")
    .replace("parent_slug, job_id,", "parent_slug.v AS parent_slug, job_id,"))
def _(t):
    store = imported(t, t.shape(shapes.CATEGORIES), CATEGORIES,
                     F.col("submission_id") != "suppliers")
    return read_back(store, CATEGORIES, "name", "parent_slug")


# Regions and nations first; then leaves, some under a parent that is nowhere, and chains that
# grow beyond the limit of depth.
LEAF_TREE = f"""
SELECT 'leaves' AS submission_id, name, parent FROM ({shapes.LEAF_ROWS})
UNION ALL SELECT 'stored', name, parent FROM ({shapes.STORED_TREE})"""


@query("udf2_run_outcomes", f"""
WITH RECURSIVE accepted AS MATERIALIZED ({tree_sql(shapes.LEAF_ROWS)}),
tree AS MATERIALIZED (SELECT * FROM accepted UNION ALL ({tree_sql(shapes.STORED_TREE)})),
{walk_sql('tree', 'walk')},
judged AS (SELECT w.slug, outcome, culprit, outcome IN ('missing', 'cycle')
    AND parent_slug IN (SELECT slug FROM accepted) AS waits
  FROM walk w WHERE outcome IS NOT NULL)
SELECT slug, CASE WHEN outcome = 'ok' THEN 'succeeded' WHEN waits THEN 'dead_letter'
    ELSE 'failed' END AS status, CAST(CASE WHEN waits THEN 3 ELSE 1 END AS INTEGER)
    AS attempt_count, CAST(CASE WHEN waits THEN 3 ELSE 1 END AS BIGINT) AS logged,
  outcome = 'ok' AS stored, CASE outcome WHEN 'missing' THEN 'parent category ''' || culprit ||
    ''' does not exist -- import it first, then re-import this record'
  WHEN 'too_deep' THEN 'parent category chain exceeds the maximum supported depth' END AS last_error
FROM judged""")
def _(t):
    rows = t.shape(LEAF_TREE).select(
        "submission_id", F.xxhash64("name").alias("row_index"), "name",
        F.col("parent").alias("parent_slug"))
    store = imported(t, rows, CATEGORIES, F.col("submission_id") == "stored",
                     ["name", "parent_slug"])
    state = store.state()
    jobs = store.log("jobs", state).withColumn("slug", F.get_json_object("payload", "$.slug"))
    logged = store.log("attempts", state).groupBy(F.col("job_id").alias("id")).agg(
        F.count(F.lit(1)).alias("logged"))
    written = store.rows("categories", state).select("slug", F.lit(True).alias("stored"))
    return jobs.join(logged, "id").join(written, "slug", "left").select(
        "slug", "status", "attempt_count", "logged",
        F.coalesce("stored", F.lit(False)).alias("stored"), "last_error")


@query("snk1_bucketed_upsert", f"""
WITH base AS (SELECT p_partkey AS key, p_name AS name, p_retailprice AS price FROM part),
one AS (SELECT min(key) AS key FROM base)
SELECT count(*) AS rows_now, CAST(count(DISTINCT name) AS BIGINT) AS names,
  CAST(sum(CAST(round(100 * CASE WHEN key IN (SELECT key FROM one) THEN 1 ELSE price END) AS BIGINT))
    AS BIGINT) AS cents, CAST(16 AS BIGINT) AS buckets, CAST(15 AS BIGINT) AS untouched,
  CAST(sum(CASE WHEN key IN (SELECT key FROM one) THEN key END) AS BIGINT) AS changed
FROM base""")
def _(t):
    store = Store(t.spark, fresh_path(t.spark, "store"))
    columns = [F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
               F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("id")]
    parts = t["part"].select(*columns, F.lit(1).alias("created_at"))
    first = t["part"].agg(F.min("p_partkey").alias("key"))
    for rows in (parts, parts.join(first, "key").withColumns({
            "price": F.lit(1.0), "id": F.lit(-1).cast("bigint"), "created_at": F.lit(2)})):
        batch = store.begin()
        batch.upsert("parts", rows, ["key"], buckets=16)
        batch.commit()
    before, after = (store.state(v).keyed["parts"]["paths"] for v in (1, 2))
    untouched = sum(before[b] == p for b, p in after.items())
    # An updated row keeps its id and creation time; only its price is new.
    return store.rows("parts").agg(
        F.count(F.lit(1)).alias("rows_now"), F.countDistinct("name").alias("names"),
        F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"),
        F.lit(len(after)).cast("bigint").alias("buckets"),
        F.lit(untouched).cast("bigint").alias("untouched"),
        F.sum(F.when((F.col("price") == 1) & (F.col("created_at") == 1), F.col("id")))
        .alias("changed"))
