"""Jobs of a workload: creation, admission, attempts, retries, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.functions.status import DEFAULT_RETRY_POLICY
from sluice.lineage import cut
from sluice.operators.ranges import dense_index, number_by_range
from sluice.operators.skew import first_n, lookup
from sluice.plans.targets import Target

KIB = 1024


def default_retry_policy() -> Column:
    p = DEFAULT_RETRY_POLICY
    return F.struct(F.lit(p["max_attempts"]).alias("max_attempts"),
                    F.lit(p["initial_backoff_ms"]).cast("bigint").alias("initial_backoff_ms"),
                    F.lit(p["max_backoff_ms"]).cast("bigint").alias("max_backoff_ms"),
                    F.lit(p["backoff_multiplier"]).alias("backoff_multiplier"))


def payloads(accepted: DataFrame, target: Target) -> DataFrame:
    """``(submission_id, row_index, natural key, payload)`` of accepted records."""
    fields = target.payload()
    if "parent_in_submission" in accepted.columns:
        fields = [*fields, F.when(F.col("parent_in_submission"), F.lit("true"))
                  .alias("parent_in_submission")]
    return accepted.select("submission_id", "row_index", target.key,
                           fn.payload_json(*fields).alias("payload"))


def fan_out_jobs(accepted: DataFrame, target: Target, now: Column) -> tuple[DataFrame, DataFrame]:
    """One workload per submission and one queued job per accepted record.

    Ids are computed from submission and row, so a retried task or a replayed
    batch creates the same rows again instead of new ones.
    """
    workload_id = fn.stable_uuid(F.lit(target.job_type), F.col("submission_id"))
    items = payloads(accepted, target)
    workloads = (items.groupBy("submission_id").agg(F.count(F.lit(1)).alias("total_items"))
                 .select(workload_id.alias("id"), F.lit(target.job_type).alias("type"),
                         "total_items", now.alias("created_at"), now.alias("updated_at")))
    jobs = items.select(
        fn.stable_uuid(F.lit(target.job_type), F.col("submission_id"),
                       F.col("row_index")).alias("id"),
        F.lit(target.job_type).alias("queue_name"), "payload", F.lit(0).alias("priority"),
        F.lit("queued").alias("status"), F.lit(0).alias("attempt_count"),
        default_retry_policy().alias("retry_policy"),
        F.lit(None).cast("string").alias("last_error"),
        now.alias("created_at"), now.alias("updated_at"),
        F.lit(target.job_type).alias("job_type"), workload_id.alias("workload_id"))
    return workloads, jobs


# --------------------------------------------------------------- requests

def check_job_requests(requests: DataFrame) -> DataFrame:
    """Reject reason per request (NULL when the job may be created)."""
    rules = [
        (F.col("queue_name") == "", "queue_name must not be empty"),
        (fn.longer_than(F.col("queue_name"), 128), "queue_name must be <= 128 characters"),
        (F.col("payload") == "", "payload must not be empty"),
        (fn.longer_than(F.col("payload"), 256 * KIB),
         f"payload must be <= {256 * KIB} bytes"),
        (fn.longer_than(F.col("job_type"), 128), "job_type must be <= 128 characters"),
        (F.col("max_attempts") == 0, "retry_policy.max_attempts must be >= 1"),
    ]
    return requests.withColumn(
        "reason", F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in rules]))


def check_schedulable(jobs: DataFrame, handler_types: list[str]) -> DataFrame:
    """Why a job cannot be scheduled (NULL when it can)."""
    name = F.concat(F.lit("job '"), F.col("id").cast("string"), F.lit("' "))
    # A job without a type has the empty one.
    job_type = F.coalesce("job_type", F.lit(""))
    reason = F.coalesce(
        F.when(fn.is_terminal(F.col("status")),
               F.concat(name, F.lit("is already in a terminal state"))),
        F.when(job_type == "",
               F.concat(name, F.lit("has no job_type; cannot be scheduled for execution"))),
        F.when(~F.col("job_type").isin(*handler_types),
               F.concat(F.lit("no handler registered for job type '"), F.col("job_type"),
                        F.lit("'"))))
    return jobs.withColumn("reason", reason)


def apply_commands(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome of `cancel` and `queue` commands: not_found, conflict or applied."""
    state = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("_status"))
    found = lookup(commands, state, ["job_id"], spread=["command_id"])
    outcome = (F.when(F.col("_status").isNull(), "not_found")
               .when(fn.is_terminal(F.col("_status")), "conflict").otherwise("applied"))
    after = F.when(outcome == "applied",
                   F.when(F.col("command") == "cancel", "cancelled").otherwise("queued"))
    return (found.withColumn("outcome", outcome)
            .withColumn("new_status", F.coalesce(after, F.col("_status"))).drop("_status"))


# ------------------------------------------------------ order and admission

def priority_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("priority"), "created_at", "id")


def next_of_queue(jobs: DataFrame, n: int) -> DataFrame:
    """The next ``n`` jobs of every queue."""
    return first_n(jobs, ["queue_name"], [F.desc("priority"), F.col("created_at"), F.col("id")],
                   n, spread=["id"], rank="turn")


def admit_by_capacity(jobs: DataFrame, capacity: int) -> DataFrame:
    """Accept the first ``capacity`` arrivals of each queue, refuse the others."""
    admitted = first_n(jobs.select("queue_name", "created_at", "id"), ["queue_name"],
                       [F.col("created_at"), F.col("id")], capacity, spread=["id"],
                       rank="_turn").select("id", F.lit(True).alias("_in"))
    full = F.lit("scheduler queue is at capacity")
    return (jobs.join(admitted, "id", "left")
            .withColumn("admitted", F.col("_in").isNotNull())
            .withColumn("reason", F.when(F.col("_in").isNull(), full)).drop("_in"))


def status_batch(jobs: DataFrame, status: str, n: int) -> DataFrame:
    """The ``n`` jobs of a status that changed longest ago."""
    return jobs.filter(F.col("status") == status).orderBy("updated_at", "id").limit(n)


def due_at(jobs: DataFrame) -> Column:
    """Time a retrying job may run again."""
    policy = jobs["retry_policy"]
    wait = fn.compute_backoff(F.col("attempt_count"), policy["initial_backoff_ms"],
                              policy["max_backoff_ms"], policy["backoff_multiplier"])
    return F.timestamp_micros(F.unix_micros(F.col("updated_at").cast("timestamp")) + wait * 1000)


def due_retries(jobs: DataFrame, now: Column, n: int | None = 50) -> DataFrame:
    """Retrying jobs whose backoff has passed, oldest change first.

    The due test comes before the limit, so jobs far in the future cannot
    crowd out those that are due.  ``n=None`` returns all of them.
    """
    due = jobs.filter((F.col("status") == "retrying") & (due_at(jobs) <= now))
    return due if n is None else due.orderBy("updated_at", "id").limit(n)


def still_retrying(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates whose newest stored state is still `retrying`."""
    current = latest.filter(F.col("status") == "retrying").select("id")
    return candidates.join(current, "id", "left_semi")


# ---------------------------------------------------------------- attempts

def number_attempts(attempts: DataFrame, base: str = "attempt_number") -> DataFrame:
    """Attempt number per job by start time, then id; a busy job is laid in many ranges."""
    return number_by_range(attempts, ["job_id"], ["started_at", "attempt_id"], base)


def apply_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold a log of attempts into the jobs they belong to.

    ``attempts``: job_id, attempt_id, started_at, finished_at, outcome
    (succeeded, failed, timed_out, cancelled), retryable, error_message.

    An attempt ends a job when it succeeds, is cancelled, or is a retryable
    failure that uses up the policy; later attempts are skipped.  All attempts
    before the ending one are failures that leave the job runnable, so the
    final state depends only on the ending attempt and the one before it.

    The log is read once: laid out by job and time, it meets the jobs' budgets and is written
    with each attempt's number.  One partially aggregated pass over that finds the ends.
    """
    live = jobs.filter(~fn.is_terminal(F.col("status")))
    columns = ["job_id", "outcome", "retryable", "finished_at", "error_message"]
    indexed = dense_index(attempts, ["job_id", "started_at", "attempt_id"], columns, index="_at")
    spans = indexed.groupBy("job_id").agg(F.min("_at").alias("_first"),
                                          F.count(F.lit(1)).alias("_n"))
    limits = live.select(F.col("id").alias("job_id"),
                         F.greatest(F.col("max_attempts") - F.col("attempt_count"),
                                    F.lit(1)).alias("_left"))
    # One row per job on both sides.
    budgets = spans.join(limits, "job_id")
    nth = (F.col("_at") - F.col("_first") + 1).cast("bigint")
    numbered = cut(lookup(indexed, budgets, ["job_id"], spread=["_at"]).filter(
        F.col("_left").isNotNull()).select(*columns, "_left", nth.alias("_nth")), "numbered")
    failed_retryable = (F.col("outcome") == "failed") & F.col("retryable")
    ending = (F.col("outcome").isin("succeeded", "cancelled")
              | (failed_retryable & (F.col("_nth") >= F.col("_left"))))
    facts = F.struct("outcome", "retryable", "finished_at", "error_message", "_nth")
    ends = numbered.groupBy("job_id").agg(
        F.min_by(F.when(ending, facts), F.when(ending, F.col("_nth"))).alias("_end"),
        F.max_by(facts, "_nth").alias("_latest"))
    stops = ends.select("job_id", F.col("_end").isNotNull().alias("_ended"),
                        F.coalesce("_end", "_latest").alias("_last"))
    # Where the last attempt did not fail, the error is that of the one before it.
    is_failure = F.col("_last.outcome").isin("failed", "timed_out")
    asked = stops.filter(~is_failure).select("job_id", (F.col("_last._nth") - 1).alias("_nth"))
    earlier = numbered.join(asked, ["job_id", "_nth"]).select(
        "job_id", F.when(F.col("outcome").isin("failed", "timed_out"), F.col("error_message"))
        .alias("_earlier"))
    verdict = stops.join(earlier, "job_id", "left").select(
        F.col("job_id").alias("id"), "_ended", "_last",
        F.when(is_failure, F.col("_last.error_message")).otherwise(F.col("_earlier"))
        .alias("_error"))
    joined = jobs.join(verdict, "id", "left")
    ran = F.col("_last").isNotNull()
    outcome = F.col("_last.outcome")
    status = (F.when(~ran, F.col("status"))
              .when(outcome.isin("succeeded", "cancelled"), outcome)
              .when((outcome == "failed") & F.col("_last.retryable"),
                    F.when(F.col("_ended"), "dead_letter").otherwise("retrying"))
              .otherwise("failed"))
    used = F.when(ran, F.col("_last._nth") - F.when(outcome == "cancelled", 1).otherwise(0))
    return joined.select(
        *[c for c in jobs.columns if c not in ("status", "attempt_count", "last_error",
                                               "updated_at")],
        status.alias("status"),
        (F.col("attempt_count") + F.coalesce(used, F.lit(0))).cast("bigint")
        .alias("attempt_count"),
        F.coalesce("_error", "last_error").alias("last_error"),
        F.coalesce(F.col("_last.finished_at"), F.col("updated_at")).alias("updated_at"))


def job_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempt history with the job's own columns beside it."""
    state = jobs.select(F.col("id").alias("job_id"), F.col("job_type"), F.col("status"))
    return lookup(attempts, state, ["job_id"], spread=["attempt_id"])
