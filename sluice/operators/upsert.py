"""Writing keyed tables: upsert, insert-if-absent, strict insert, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns an update leaves as they were first written.
KEPT = ("id", "created_at")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
           kept: Sequence[str] = KEPT) -> DataFrame:
    """The table after inserting new keys and overwriting known ones.

    Both sides have unique ``keys`` and the same columns.  A matched row takes
    every incoming value, NULLs included, except the ``kept`` columns.
    """
    keys = list(keys)
    others = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*others).alias("_old"))
    new = incoming.select(*keys, F.struct(*others).alias("_new"))
    merged = old.join(new, keys, "full_outer")
    arrived = F.col("_new").isNotNull()
    known = F.col("_old").isNotNull()

    def value(column: str):
        if column in kept:
            return F.when(known, F.col("_old")[column]).otherwise(F.col("_new")[column])
        return F.when(arrived, F.col("_new")[column]).otherwise(F.col("_old")[column])

    return merged.select(*[value(c).alias(c) if c in others else F.col(c)
                           for c in stored.columns])


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def conflicts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming keys that are stored already or come more than once."""
    counted = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    present = stored.select(*keys, F.lit(True).alias("_stored")).dropDuplicates(list(keys))
    return (counted.join(present, list(keys), "left")
            .filter((F.col("_n") > 1) | F.col("_stored"))
            .select(*keys, F.col("_stored").isNotNull().alias("already_stored"),
                    F.col("_n").alias("times_given")))


def insert_strict(stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  path: str) -> None:
    """Append ``incoming`` to the table at ``path``; any conflict fails the whole insert."""
    clash = conflicts(stored, incoming, keys).limit(1)
    if not clash.isEmpty():
        raise ValueError(f"insert conflict on {clash.first().asDict()}")
    incoming.write.mode("append").parquet(path)


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append rows to the attempt log."""
    attempts.write.mode("append").parquet(path)


def persisted_difference(confirmed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Confirmed keys that did not reach the stored table (should be empty)."""
    return confirmed.select(key).distinct().join(stored.select(key), key, "left_anti")
