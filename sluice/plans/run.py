"""Confirm, run, store: the jobs of confirmed records and the rows they leave, as one batch.

The handlers' results decide, in one pass each: which attempts are logged, the final state of
every job, and which records are upserted, with the job that wrote them.  All tables change in
one version of a ``Store``: a batch that is killed on the way leaves nothing visible, and a
repeated batch of a stream is not applied again.

A job that fails for good has one attempt.  One that waits for a parent of its own submission
which never lands uses up its retries and ends as dead letter.  Of several jobs that write one
key the last one counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.lineage import cut
from sluice.operators import progress
from sluice.operators.upsert import persisted_difference
from sluice.plans.handlers import RESULT, category_handler, record_handler
from sluice.plans.submission import Confirmed, confirm
from sluice.plans.targets import CATEGORIES, Target
from sluice.sources.store import Batch, Store

# Columns that are stored as numbers; payloads hold text.
STORED_TYPES = {"price": "decimal(12,2)", "stock_quantity": "bigint"}


@dataclass(frozen=True)
class Run:
    """What running the jobs of a batch comes to; nothing is stored yet."""

    jobs: DataFrame
    attempts: DataFrame
    records: DataFrame


def stored_edges(store: Store) -> DataFrame:
    """Slug and parent of the stored categories."""
    stored = store.rows(CATEGORIES.name)
    if stored is None:
        return store.spark.createDataFrame([], "slug string, parent_slug string")
    return stored.select("slug", "parent_slug")


def run_jobs(jobs: DataFrame, target: Target, now: Column, stored: DataFrame | None = None) -> Run:
    """Run queued jobs of one target; ``stored`` are the categories' stored edges."""
    handler = category_handler(stored) if target is CATEGORIES else record_handler(target)
    results = cut(handler(jobs.select("id", "payload", "created_at")).select(*RESULT), "results")
    outcome = results.select("id", F.col("status").alias("_outcome"), F.col("error").alias("_error"),
                             F.col("retryable").alias("_retryable"))
    # One result per job id.
    joined = jobs.join(outcome, "id", "left")
    ran = F.col("_outcome").isNotNull()
    given_up = (F.col("_outcome") == "failed") & F.col("_retryable")
    left = F.greatest(F.col("retry_policy.max_attempts") - F.col("attempt_count"), F.lit(1))
    tries = F.when(~ran, 0).when(given_up, left).otherwise(1)
    status = (F.when(~ran, F.col("status")).when(given_up, "dead_letter")
              .otherwise(F.col("_outcome")))
    final = joined.withColumns({
        "status": status,
        "attempt_count": (F.col("attempt_count") + tries).cast("int"),
        "last_error": F.coalesce("_error", "last_error"),
        "updated_at": F.when(ran, now).otherwise(F.col("updated_at"))}).select(*jobs.columns)
    numbered = joined.filter(ran).select(
        F.col("id").alias("job_id"), "attempt_count", "_outcome", "_error", "_retryable",
        F.explode(F.sequence(F.lit(1), tries)).alias("_nth"))
    number = F.col("attempt_count") + F.col("_nth")
    attempts = numbered.select(
        fn.stable_uuid(F.lit("attempt"), F.col("job_id"), number).alias("id"), "job_id",
        F.lit(None).cast("string").alias("worker_id"), number.alias("attempt_number"),
        F.col("_outcome").alias("outcome"), F.col("_retryable").alias("retryable"),
        now.alias("started_at"), now.alias("finished_at"), F.col("_error").alias("error_message"))
    return Run(final, attempts, records_of(results, jobs, target, now))


def records_of(results: DataFrame, jobs: DataFrame, target: Target, now: Column) -> DataFrame:
    """The rows that successful jobs write: one per key, with ``id`` and ``job_id``."""
    kind = ", ".join(f"{c} string" for c in target.columns)
    written = (results.filter(F.col("status") == "succeeded")
               .join(jobs.select("id", F.col("created_at").alias("_queued")), "id")
               .select(F.col("id").alias("job_id"), "_queued",
                       F.from_json("output", kind).alias("_r")))
    values = [F.col(f"_r.{c}").cast(STORED_TYPES.get(c, "string")).alias(c)
              for c in target.columns if c != target.key]
    last = written.groupBy(F.col(f"_r.{target.key}").alias(target.key)).agg(F.max_by(
        F.struct(*values, "job_id"), F.struct("_queued", "job_id")).alias("_last"))
    return last.select(
        fn.stable_uuid(F.lit(target.name), F.col(target.key)).alias("id"), target.key, "_last.*",
        now.alias("created_at"), now.alias("updated_at"))


def store_run(store: Store, done: Confirmed, run: Run, target: Target, app: str | None = None,
              number: int | None = None) -> int | None:
    """Write a run as the next version; None if the stream's batch was applied before."""
    def write(batch: Batch) -> None:
        batch.append("workloads", done.workloads)
        batch.append("jobs", run.jobs)
        batch.append("attempts", run.attempts)
        batch.append("rejects", done.rejects)
        batch.upsert(target.name, run.records, [target.key])
    return store.apply(write, app, number)


def run_confirmed(store: Store, done: Confirmed, target: Target, now: Column,
                  app: str | None = None, number: int | None = None) -> int | None:
    """Run and store what was confirmed."""
    if app is not None and store.begin(app, number) is None:
        return None
    stored = stored_edges(store) if target is CATEGORIES else None
    return store_run(store, done, run_jobs(done.jobs, target, now, stored), target, app, number)


def import_records(store: Store, records: DataFrame, target: Target, now: Column,
                   app: str | None = None, number: int | None = None) -> int | None:
    """Confirm records under canonical names, run their jobs, store everything at once."""
    if records.isEmpty():
        raise ValueError("at least one record is required")
    return run_confirmed(store, confirm(records, target, now), target, now, app, number)


def stored_provenance(store: Store, target: Target) -> DataFrame:
    """Stored record -> job -> workload, read back from one version."""
    state = store.state()
    return progress.provenance(store.rows(target.name, state), store.log("jobs", state),
                               store.log("workloads", state), target.key)


def lost_keys(store: Store, target: Target) -> DataFrame:
    """Keys of succeeded jobs that are not stored (none, unless something is wrong)."""
    state = store.state()
    written = (store.log("jobs", state)
               .filter((F.col("status") == "succeeded") & (F.col("job_type") == target.job_type))
               .select(fn.payload_field(F.col("payload"), target.key).alias(target.key)))
    return persisted_difference(written, store.rows(target.name, state), target.key)
