"""Stored tables: scans, versioned snapshots and an append-only change log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import files
from sluice.operators.dedupe import latest_versions
from sluice.operators.upsert import upsert


def scan(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a stored table; `fmt` may be any installed source, jdbc included."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.load(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below ``root``; a directory listing, not data."""
    found = [n for n in files.names(spark, root) if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in found
                  if "_SUCCESS" in files.names(spark, f"{root}/{n}"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version of a table, if there is one."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/version={versions[-1]}") if versions else None


def write_upsert(spark: SparkSession, root: str, incoming: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Upsert into the newest version and write the whole table as the next one.

    For small tables; ``store.Store`` rewrites touched buckets only.  Readers keep the
    version they started with; a failed write leaves no `_SUCCESS` and is never read.  A
    number is claimed before it is written, so that of two writers one is refused.
    """
    current = latest_snapshot(spark, root)
    claimed = [int(n) for n in files.names(spark, f"{root}/_claims")]
    number = max([0, *_versions(spark, root), *claimed]) + 1
    if not files.create_once(spark, f"{root}/_claims/{number}", uuid.uuid4().hex):
        raise RuntimeError(f"version {number} of {root} is being written by another writer")
    merged = incoming if current is None else upsert(current, incoming, keys)
    merged.write.mode("overwrite").parquet(f"{root}/version={number}")
    return spark.read.parquet(f"{root}/version={number}")


# Change log: each batch of upserts is one partition, so the cost of a batch
# follows the batch and not the table.

def append_changes(changes: DataFrame, root: str, batch_id: int) -> None:
    """Write one batch of changes; writing the same batch again replaces it."""
    (changes.withColumn("change_seq", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}"))


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("batch_id")


def current_rows(changes: DataFrame, keys: Sequence[str],
                 version: Sequence[str] = ("change_seq",)) -> DataFrame:
    """The table the log adds up to: last values, first creation time."""
    return latest_versions(changes, keys, version).drop("change_seq")
