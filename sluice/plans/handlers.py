"""Job handlers by type, each a DataFrame-to-DataFrame transform.

A handler receives the jobs of its type and returns ``(id, status, output,
error, retryable)`` with status `succeeded` or `failed`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.lineage import cut
from sluice.operators import hierarchy, validate
from sluice.operators.skew import lookup
from sluice.plans.targets import CATEGORIES, PRODUCTS, USERS, Target

Handler = Callable[[DataFrame], DataFrame]
KIB = 1024
RESULT = ("id", "status", "output", "error", "retryable")


class HandlerRegistry:
    """Names of job types and the transform that runs each of them."""

    def __init__(self) -> None:
        self._handlers: dict[str, Handler] = {}

    def register(self, job_type: str, handler: Handler) -> None:
        if job_type in self._handlers:
            raise ValueError(f"a handler is already registered for job type '{job_type}'")
        self._handlers[job_type] = handler

    def resolve(self, job_type: str) -> Handler:
        if job_type not in self._handlers:
            raise KeyError(f"no handler registered for job type '{job_type}'")
        return self._handlers[job_type]

    def types(self) -> list[str]:
        return sorted(self._handlers)

    def run(self, jobs: DataFrame) -> DataFrame:
        """Results of all jobs: each type by its handler, unknown types fail.

        The jobs are evaluated once, into the shared folder; each handler reads
        its own type from there.  A job without a type has the empty one.
        """
        jobs = cut(jobs.withColumn("job_type", F.coalesce("job_type", F.lit(""))), "typed-jobs")
        known = F.col("job_type").isin(*self._handlers)
        result = jobs.filter(~known).select(
            "id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("output"),
            F.concat(F.lit("no handler registered for job type '"), F.col("job_type"),
                     F.lit("'")).alias("error"), F.lit(False).alias("retryable"))
        for job_type, handler in self._handlers.items():
            part = handler(jobs.filter(F.col("job_type") == job_type))
            result = result.unionByName(part.select(*RESULT))
        return result


def as_result(rows: DataFrame, error: str = "reason",
              retryable: Column | None = None) -> DataFrame:
    """Result columns from rows with ``id``, ``output`` and an error column."""
    failed = F.col(error).isNotNull()
    return rows.select(
        "id", F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(~failed, F.col("output")).alias("output"), F.col(error).alias("error"),
        (F.lit(False) if retryable is None else failed & retryable).alias("retryable"))


def check_payloads(jobs: DataFrame, target: Target) -> DataFrame:
    """Parse the payloads of one job type and validate them again.

    Adds the target's normalised columns, ``reason`` and ``output``.
    """
    limit = 16 * KIB
    parsed = jobs.select("*", *[fn.payload_field(F.col("payload"), c).alias(c)
                                for c in target.columns])
    missing = [F.when(F.col(c).isNull(),
                      F.lit(f"'{c}' is required and must be a JSON string"))
               for c in target.required]
    early = F.coalesce(
        F.when(fn.longer_than(F.col("payload"), limit),
               F.lit(f"{target.job_type} payload must be <= {limit} bytes")), *missing)
    checked = validate.annotate(parsed.withColumn("reason", early), target)
    return checked.withColumn("output", fn.payload_json(*target.payload()))


def record_handler(target: Target) -> Handler:
    """Handler of a target whose records stand alone (users, products)."""
    return lambda jobs: as_result(check_payloads(jobs, target))


def category_handler(stored: DataFrame) -> Handler:
    """Handler of categories: parents are looked up in ``stored`` and the batch."""
    def run(jobs: DataFrame) -> DataFrame:
        checked = check_payloads(jobs, CATEGORIES)
        accepted = checked.filter(F.col("reason").isNull())
        # One edge per slug: with several jobs the last one written counts.
        edges = (accepted.groupBy("slug").agg(F.max_by(
            F.struct("parent_slug"), F.struct("created_at", "id")).alias("_edge"))
            .select("slug", F.col("_edge.parent_slug").alias("parent_slug")))
        verdicts = hierarchy.hierarchy_resolve(stored, edges)
        text = verdicts.select(
            "slug", hierarchy.outcome_message(F.col("outcome"), F.col("culprit"))
            .alias("_tree_reason"), F.col("outcome").isin("missing", "cycle").alias("_absent"))
        judged = lookup(checked, text, ["slug"], spread=["id"])
        # A parent that comes with the same submission may land later: such jobs retry.
        waits = (F.col("reason").isNull() & F.coalesce("_absent", F.lit(False)) & F.coalesce(
            fn.payload_field(F.col("payload"), "parent_in_submission") == "true", F.lit(False)))
        judged = judged.withColumn("_waits", waits).withColumn(
            "reason", F.coalesce("reason", "_tree_reason"))
        return as_result(judged, retryable=F.col("_waits"))
    return run


def uppercase(jobs: DataFrame) -> DataFrame:
    """The `transform` job type: payload in upper case, up to 256 KiB."""
    limit = 256 * KIB
    too_long = F.when(fn.longer_than(F.col("payload"), limit),
                      F.lit(f"transform payload must be <= {limit} bytes"))
    return as_result(jobs.select("id", fn.ascii_upper(F.col("payload")).alias("output"),
                                 too_long.alias("reason")))


def builtin_registry(stored_categories: DataFrame) -> HandlerRegistry:
    registry = HandlerRegistry()
    registry.register("transform", uppercase)
    registry.register(USERS.job_type, record_handler(USERS))
    registry.register(PRODUCTS.job_type, record_handler(PRODUCTS))
    registry.register(CATEGORIES.job_type, category_handler(stored_categories))
    return registry
