"""Derived progress, ingestion summaries, attempt counters, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.operators.skew import lookup


def status_counts(jobs: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per workload: the four buckets and the two sub-counts; a row counts as ``weight``."""
    bucket = fn.classify_job_status(F.col("status"))

    def among(condition: Column, name: str) -> Column:
        if weight is None:
            return F.count_if(condition).alias(name)
        return F.sum(F.when(condition, weight).otherwise(0)).cast("bigint").alias(name)

    return jobs.filter(F.col("workload_id").isNotNull()).groupBy("workload_id").agg(
        among(bucket == "queued", "queued_items"),
        among(bucket == "running", "running_items"),
        among(bucket == "succeeded", "completed_items"),
        among(bucket == "failed", "failed_items"),
        among(F.col("status") == "retrying", "retrying_items"),
        among(F.col("status") == "dead_letter", "dead_letter_items"))


COUNTS = ("queued_items", "running_items", "completed_items", "failed_items",
          "retrying_items", "dead_letter_items")


def workload_progress(workloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts, status and percentage of every workload, empty ones included."""
    counts = status_counts(jobs).withColumnRenamed("workload_id", "id")
    joined = workloads.join(counts, "id", "left").fillna(0, list(COUNTS))
    completed, failed = F.col("completed_items"), F.col("failed_items")
    return joined.withColumns({
        "status": fn.derive_workload_status(F.col("total_items"), completed, failed),
        "percent": fn.progress_percent(F.col("total_items"), completed + failed),
    })


def workload_jobs(workloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with the type and size of their workload (NULL when they have none)."""
    sizes = workloads.select(F.col("id").alias("workload_id"),
                             F.col("type").alias("workload_type"), "total_items")
    return lookup(jobs, sizes, ["workload_id"], spread=["id"])


def ingest_summary(annotated: DataFrame) -> DataFrame:
    """Rows, valid rows and rejected rows per submission."""
    valid = F.col("reason").isNull()
    return annotated.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(~valid).alias("invalid_records"))


def reject_reasons(annotated: DataFrame) -> DataFrame:
    """Number of rejects per reason."""
    return (annotated.filter(F.col("reason").isNotNull()).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("rejects")))


def ingest_checked(summary: DataFrame, workloads: DataFrame) -> DataFrame:
    """The counts of every submission with its jobs, and whether they are ``broken``:
    `total = valid + rejected` and `valid = jobs` must hold."""
    totals = workloads.select("submission_id", "total_items")
    checked = summary.join(totals, "submission_id", "left").withColumn(
        "total_items", F.coalesce("total_items", F.lit(0).cast("bigint")))
    return checked.withColumn("broken", (
        F.col("total_records") != F.col("valid_records") + F.col("invalid_records"))
        | (F.col("total_items") != F.col("valid_records")))


def ingest_invariants(summary: DataFrame, workloads: DataFrame) -> DataFrame:
    """Submissions that break one of the rules of ``ingest_checked``."""
    return ingest_checked(summary, workloads).filter("broken")


def table_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("total"))


def attempt_label(outcome: Column, retryable: Column, attempt_number: Column,
                  max_attempts: Column) -> Column:
    """Which counter one finished attempt adds to."""
    retried = F.when(fn.exhausted(attempt_number, max_attempts), "dead_letter").otherwise(
        "retrying")
    return F.when((outcome == "failed") & retryable, retried).otherwise(outcome)


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts and run time in ms per result.

    Needs outcome, retryable, attempt_number, max_attempts, started_at,
    finished_at.
    """
    label = attempt_label(F.col("outcome"), F.col("retryable"), F.col("attempt_number"),
                          F.col("max_attempts"))
    micros = (F.unix_micros(F.col("finished_at").cast("timestamp"))
              - F.unix_micros(F.col("started_at").cast("timestamp")))
    timed = attempts.select(label.alias("result"), F.floor(micros / 1000).alias("_ms"))
    return timed.groupBy("result").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("_ms").alias("total_ms"),
        F.min("_ms").alias("min_ms"), F.max("_ms").alias("max_ms"))


def attempt_counters(attempts: DataFrame) -> DataFrame:
    """The counters of an executor: ``started`` and one per result, with their run times.

    Every attempt was started; an attempt without an outcome yet counts there alone.
    """
    finished = attempt_outcomes(attempts.filter(F.col("outcome").isNotNull()))
    # At most six results are added up.
    every = finished.agg(F.struct(
        F.sum("total_ms").alias("total_ms"), F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms")).alias("every")).scalar()
    started = attempts.agg(F.count(F.lit(1)).alias("attempts")).select(
        F.lit("started").alias("result"), "attempts", every.alias("_every"))
    return finished.unionByName(started.select("result", "attempts", "_every.*"))


def provenance(records: DataFrame, jobs: DataFrame, workloads: DataFrame,
               record_key: str) -> DataFrame:
    """Record -> job -> workload; either link may be absent."""
    job_links = jobs.select(F.col("id").alias("job_id"), "workload_id",
                            F.col("status").alias("job_status"))
    with_job = lookup(records, job_links, ["job_id"], spread=[record_key])
    kinds = workloads.select(F.col("id").alias("workload_id"),
                             F.col("type").alias("workload_type"))
    # Records per workload from records per job: the first lookup is not run again.
    per_job = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    weights = (job_links.join(per_job, "job_id").groupBy("workload_id")
               .agg(F.sum("_n").alias("_n")))
    return lookup(with_job, kinds, ["workload_id"], spread=[record_key], weights=weights)
