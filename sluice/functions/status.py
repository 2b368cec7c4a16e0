"""Job and workload states, retry arithmetic, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored texts of each state set.
JOB_STATUSES = ("pending", "queued", "running", "succeeded",
                "failed", "retrying", "cancelled", "dead_letter")
TERMINAL_JOB_STATUSES = ("succeeded", "cancelled", "dead_letter")
WORKLOAD_STATUSES = ("pending", "queued", "running", "succeeded", "failed")
ATTEMPT_OUTCOMES = ("running", "succeeded", "failed", "timed_out", "cancelled")
SOURCE_TYPES = ("csv", "image", "screenshot", "text", "url")

# The retry policy of a job that names none.
DEFAULT_RETRY_POLICY = {"max_attempts": 3, "initial_backoff_ms": 1000,
                        "max_backoff_ms": 60000, "backoff_multiplier": 2.0}


def is_terminal(status: Column) -> Column:
    """No further transition is allowed; `failed` may still be run again."""
    return status.isin(*TERMINAL_JOB_STATUSES)


def compute_backoff(attempts: Column, initial_ms: Column, max_ms: Column,
                    multiplier: Column) -> Column:
    """Delay in ms before the next attempt: geometric growth up to a ceiling."""
    initial = initial_ms.cast("double")
    ceiling = max_ms.cast("double")
    grown = initial * F.pow(multiplier, attempts - 1)
    # 0 * infinity is NaN; a zero first delay never grows.
    grown = F.when(initial == 0, F.lit(0.0)).otherwise(grown)
    # A shrinking series that starts above the ceiling stops there at once.
    stuck = (attempts >= 2) & (initial * multiplier >= ceiling)
    delay = F.when(stuck, ceiling).otherwise(F.least(grown, ceiling))
    return F.when(attempts == 0, F.lit(0).cast("bigint")).otherwise(delay.cast("bigint"))


def exhausted(attempts: Column, max_attempts: Column) -> Column:
    return attempts >= max_attempts


def classify_job_status(status: Column) -> Column:
    """The four progress buckets of a workload."""
    return (F.when(status == "succeeded", "succeeded")
            .when(status.isin("cancelled", "dead_letter", "failed"), "failed")
            .when(status == "running", "running")
            .when(status.isin("pending", "queued", "retrying"), "queued"))


def derive_workload_status(total: Column, completed: Column, failed: Column) -> Column:
    return (F.when(total == 0, "succeeded")
            .when(completed + failed < total, "running")
            .when(failed > 0, "failed")
            .otherwise("succeeded"))


def progress_percent(total: Column, decided: Column) -> Column:
    """Rounded share of decided items; an empty workload is complete."""
    return (F.when(total == 0, F.lit(100))
            .otherwise(F.floor(F.lit(100.0) * decided / total + 0.5)).cast("bigint"))


def known(value: Column, allowed: tuple[str, ...]) -> Column:
    """The stored text belongs to its state set."""
    return value.isin(*allowed)
