"""Continuous ingestion: each arriving file is checked once and stored.

A micro-batch is one version of a ``Store``: job rows, attempts, upserted records with the job
that wrote them, workloads, rejects and refused files become visible together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice import functions as fn
from sluice.lineage import cut
from sluice.operators import dedupe, hierarchy, validate
from sluice.operators.align import align_maps
from sluice.operators.jobs import fan_out_jobs
from sluice.operators.skew import lookup
from sluice.plans.run import STORED_TYPES, stored_edges
from sluice.plans.targets import CATEGORIES, Target
from sluice.sources.csv import extract_csv, extract_csv_split, read_files
from sluice.sources.store import Batch, Store

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
INGEST = "ingest"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.csv",
                files_per_batch: int = 1000) -> DataFrame:
    """New files of a drop folder as ``(submission_id, length)``; their content is not read."""
    stream = (spark.readStream.schema(FILE_SCHEMA).format("binaryFile")
              .option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", files_per_batch).load(folder))
    return stream.select(F.col("path").alias("submission_id"), "length")


def settle_categories(annotated: DataFrame, stored: DataFrame) -> DataFrame:
    """Reject the accepted categories of a batch whose parents cannot be reached,
    among the stored ones and the batch itself.  Of equal slugs the last one counts."""
    accepted = annotated.filter(F.col("reason").isNull())
    edges = (accepted.groupBy("slug").agg(F.max_by(
        F.struct("parent_slug"), F.struct("submission_id", "row_index")).alias("_edge"))
        .select("slug", F.col("_edge.parent_slug").alias("parent_slug")))
    verdicts = hierarchy.hierarchy_resolve(stored, edges).select(
        "slug", hierarchy.outcome_message(F.col("outcome"), F.col("culprit")).alias("_tree"))
    found = lookup(annotated, verdicts, ["slug"], spread=["submission_id", "row_index"])
    return found.withColumn("reason", F.coalesce("reason", "_tree")).drop("_tree")


def accepted_rows(accepted: DataFrame, target: Target, now: Column) -> DataFrame:
    """The rows accepted records upsert: one per key, the last one, with id and job."""
    job = fn.stable_uuid(F.lit(target.job_type), F.col("submission_id"), F.col("row_index"))
    values = [F.col(c).cast(STORED_TYPES.get(c, "string")).alias(c) for c in target.columns
              if c != target.key]
    last = accepted.groupBy(target.key).agg(F.max_by(
        F.struct(*values, job.alias("job_id")), F.struct("submission_id", "row_index"))
        .alias("_last"))
    return last.select(fn.stable_uuid(F.lit(target.name), F.col(target.key)).alias("id"),
                       target.key, "_last.*", now.alias("created_at"), now.alias("updated_at"))


def apply_records(annotated: DataFrame, target: Target, root: str, batch_id: int,
                  time_of_batch: str | None = None, refused: DataFrame | None = None) -> None:
    """Write one micro-batch as one version; a batch that was applied is left alone.

    Records were checked just now, so their jobs succeed at the first attempt.
    """
    store = Store(annotated.sparkSession, root)
    if store.begin(INGEST, batch_id) is None:
        return
    now = F.current_timestamp() if time_of_batch is None else F.lit(time_of_batch).cast(
        "timestamp")
    if target is CATEGORIES:
        annotated = settle_categories(cut(annotated, "checked"), stored_edges(store))
    # All tables are made from these rows: evaluated once.
    accepted, rejects = validate.split(cut(annotated.drop("stage"), "settled"))
    if target is CATEGORIES:
        accepted = hierarchy.parent_in_submission(accepted)
    workloads, jobs = fan_out_jobs(accepted, target, now)
    done = jobs.withColumns({"status": F.lit("succeeded"), "attempt_count": F.lit(1)})
    attempts = jobs.select(
        fn.stable_uuid(F.lit("attempt"), F.col("id"), F.lit(1)).alias("id"),
        F.col("id").alias("job_id"), F.lit(None).cast("string").alias("worker_id"),
        F.lit(1).alias("attempt_number"), F.lit("succeeded").alias("outcome"),
        F.lit(False).alias("retryable"), now.alias("started_at"), now.alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"))

    def write(batch: Batch) -> None:
        for name, rows in (("workloads", workloads), ("jobs", done), ("attempts", attempts),
                           ("rejects", rejects), ("refused", refused)):
            if rows is not None:
                batch.append(name, rows)
        batch.upsert(target.name, accepted_rows(accepted, target, now), [target.key])

    store.apply(write, INGEST, batch_id)


def start_ingest(files: DataFrame, target: Target, root: str, checkpoint: str,
                 max_bytes: int | None = None, max_rows: int | None = None,
                 **trigger) -> StreamingQuery:
    """Run files through extraction, alignment, validation and the store.

    The stream carries paths (at most ``files_per_batch`` a batch reach the driver); without
    limits the files themselves are read in splits by many tasks.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = [r["submission_id"] for r in batch.select("submission_id").collect()]
        if not paths:
            return
        if max_bytes is None and max_rows is None:
            records, refused = extract_csv_split(spark, paths)
        else:
            records, refused = extract_csv(read_files(spark, paths, max_bytes),
                                           max_bytes=max_bytes, max_rows=max_rows)
        checked = validate.annotate(align_maps(records, target), target)
        apply_records(dedupe.keep_first(checked, target.key), target, root, batch_id,
                      refused=refused)

    return (files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_record_ingest(records: DataFrame, target: Target, root: str, checkpoint: str,
                        **trigger) -> StreamingQuery:
    """As ``start_ingest`` for a stream that already has the target's columns."""
    def each(batch: DataFrame, batch_id: int) -> None:
        checked = validate.annotate(batch, target)
        apply_records(dedupe.keep_first(checked, target.key), target, root, batch_id)

    return (records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
