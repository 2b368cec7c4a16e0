"""Natural-key duplicates within a submission, and versions across them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.skew import lookup

GROUP = ("submission_id",)


def first_occurrences(annotated: DataFrame, key: str,
                      group: Sequence[str] = GROUP) -> DataFrame:
    """For keys used more than once by valid rows: first row and row count."""
    valid = annotated.filter(F.col("reason").isNull())
    return (valid.groupBy(*group, key)
            .agg(F.min("row_index").alias("first_row"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1))


def _reject_repeats(annotated: DataFrame, key: str, reason: Column,
                    group: Sequence[str]) -> DataFrame:
    """Only repeated keys are looked up; unique keys never need the join's answer."""
    repeated = first_occurrences(annotated, key, group)
    found = lookup(annotated, repeated, [*group, key], spread=["row_index"])
    later = F.col("reason").isNull() & (F.col("row_index") > F.col("first_row"))
    return (found.withColumn("reason", F.coalesce(F.col("reason"), F.when(later, reason)))
            .drop("first_row"))


def keep_first(annotated: DataFrame, key: str, label: str | None = None,
               group: Sequence[str] = GROUP) -> DataFrame:
    """Reject every valid row whose key a valid earlier row already used."""
    reason = F.concat(F.lit(f"duplicate {label or key} '"), F.col(key),
                      F.lit("' in this submission -- only the first occurrence is kept"))
    return _reject_repeats(annotated, key, reason, group)


def keep_first_naming_row(annotated: DataFrame, key: str,
                          group: Sequence[str] = GROUP) -> DataFrame:
    """As ``keep_first``; the reason names the row that was kept."""
    reason = F.concat(F.lit(f"duplicate {key} (first seen at row "),
                      F.col("first_row").cast("string"), F.lit(")"))
    return _reject_repeats(annotated, key, reason, group)


def distinct_keys(annotated: DataFrame, key: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Number of distinct accepted keys per submission."""
    return (annotated.filter(F.col("reason").isNull()).groupBy(*group)
            .agg(F.countDistinct(key).alias("distinct_keys")))


def latest_versions(history: DataFrame, keys: Sequence[str], version: Sequence[str],
                    created: str = "created_at") -> DataFrame:
    """Replay an upsert history: last values win, first creation time stays.

    One partially aggregated pass, whatever the number of versions of a key.
    """
    values = [c for c in history.columns if c not in keys and c != created]
    latest = F.max_by(F.struct(*values), F.struct(*version)).alias("_latest")
    merged = history.groupBy(*keys).agg(latest, F.min(created).alias(created))
    return merged.select(*keys, *[F.col("_latest")[v].alias(v) for v in values], created)
