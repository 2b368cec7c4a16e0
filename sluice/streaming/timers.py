"""Retry timers: a retrying job is released when its backoff has passed.

State is one small row per retrying job.  A change of the job updates or clears
it, a timer releases it; nothing is scanned per tick, whatever the size of the
job table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.jobs import due_at
from sluice.sources.tables import append_changes

RELEASED = "id long, status string, due_ms long, released_ms long"
STATE = "changed_us long, due_ms long"


def _track(key: tuple, changes: Iterator[pd.DataFrame], state: GroupState) -> Iterator[Any]:
    now = state.getCurrentProcessingTimeMs()
    changed, due = state.get if state.exists else (-1, -1)
    if not state.hasTimedOut:
        for part in changes:
            newest = part.loc[part["changed_us"].idxmax()]
            if newest["changed_us"] > changed:
                changed = int(newest["changed_us"])
                due = int(newest["due_ms"]) if newest["status"] == "retrying" else -1
    if 0 <= due <= now:
        yield pd.DataFrame({"id": [key[0]], "status": ["queued"], "due_ms": [due],
                            "released_ms": [now]})
        due = -1
    if due >= 0:
        state.update((changed, due))
        state.setTimeoutDuration(due - now)
    elif state.exists:
        state.remove()


def release_stream(changes: DataFrame) -> DataFrame:
    """Released jobs of a stream of job rows (id, status, attempt_count, updated_at, policy).

    Only changes of jobs that retry, or were retrying, matter; a cancelled job's
    timer is cleared by its own change.
    """
    timed = changes.select(
        F.col("id").cast("bigint").alias("id"), "status",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("changed_us"),
        F.when(F.col("status") == "retrying", F.unix_millis(due_at(changes))).alias("due_ms"))
    whole = timed.fillna(-1, ["due_ms"])
    return whole.groupBy("id").applyInPandasWithState(
        _track, RELEASED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start_retry_timers(changes: DataFrame, root: str, checkpoint: str,
                       **trigger) -> StreamingQuery:
    """Log every released job below ``root``, one partition per micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        # Most ticks release nothing; they leave no files behind.
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                append_changes(batch, root, batch_id)
        finally:
            batch.unpersist()

    return (release_stream(changes).writeStream.outputMode("append").foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "500 milliseconds"})).start())
