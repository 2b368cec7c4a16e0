"""The ingestion plans: preview, confirm, direct import."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.lineage import cut
from sluice.operators import dedupe, hierarchy, jobs, progress, validate
from sluice.operators.align import align_exact, align_maps
from sluice.plans.targets import CATEGORIES, USERS, Target
from sluice.sources.csv import extract_csv, extract_csv_split


@dataclass(frozen=True)
class Preview:
    """Lazy results; nothing is written."""

    annotated: DataFrame
    records: DataFrame
    rejects: DataFrame
    summary: DataFrame
    # Mean confidence and warning per submission, where the source has them.
    notes: DataFrame | None = None


@dataclass(frozen=True)
class Confirmed:
    annotated: DataFrame
    workloads: DataFrame
    jobs: DataFrame
    rejects: DataFrame
    summary: DataFrame


def preview(records: DataFrame, target: Target, notes: DataFrame | None = None) -> Preview:
    """Align, validate and de-duplicate extracted records.

    ``records`` has submission_id, row_index, ``fields`` and the extraction's
    ``reason``.  Every reject keeps its row of the original input.
    """
    stage = F.when(F.col("reason").isNotNull(), "structural").otherwise("mapping")
    aligned = align_maps(records, target).withColumn("stage", stage)
    deduped = dedupe.keep_first(validate.annotate(aligned, target), target.key)
    accepted = deduped.filter(F.col("reason").isNull()).drop("reason", "stage")
    rejects = deduped.filter(F.col("reason").isNotNull()).select(
        "submission_id", "row_index", "stage", "reason")
    return Preview(deduped, accepted, rejects, progress.ingest_summary(deduped), notes)


def confirm(records: DataFrame, target: Target, now: Column) -> Confirmed:
    """Re-validate confirmed records and fan them out into jobs.

    ``records`` has submission_id, row_index and ``fields`` under the canonical
    names; nothing is trusted from an earlier preview.
    """
    checked = validate.annotate(align_exact(records, target), target, strict=True)
    deduped = dedupe.keep_first(checked, target.key, label="key")
    return _fan_out(deduped, target, now)


def direct_import(files: DataFrame, now: Column, max_bytes: int | None = None,
                  max_rows: int | None = None) -> tuple[Confirmed, DataFrame]:
    """Strict users CSV straight to jobs; also returns the refused files."""
    records, refused = extract_csv(files, True, max_bytes, max_rows)
    return _import_users(records, now), refused


def direct_import_path(spark: SparkSession, path: str | list[str],
                       now: Column) -> tuple[Confirmed, DataFrame]:
    """As ``direct_import`` for files of any size: they are split across tasks."""
    records, refused = extract_csv_split(spark, path, strict_users=True)
    return _import_users(records, now), refused


def _import_users(records: DataFrame, now: Column) -> Confirmed:
    checked = validate.annotate(align_exact(records, USERS), USERS)
    deduped = dedupe.keep_first_naming_row(checked, USERS.key)
    return _fan_out(deduped, USERS, now)


def _fan_out(annotated: DataFrame, target: Target, now: Column) -> Confirmed:
    # Workloads, jobs, rejects and counts are made from the same rows: evaluated once.
    annotated = cut(annotated, "confirmed")
    accepted, rejects = validate.split(annotated)
    if target is CATEGORIES:
        accepted = hierarchy.parent_in_submission(accepted)
    workloads, job_rows = jobs.fan_out_jobs(accepted, target, now)
    return Confirmed(annotated, workloads, job_rows, rejects,
                     progress.ingest_summary(annotated))
