"""Table constraints as a report of violation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows per CHECK rule that do not satisfy it; all rules in one pass.

    As in SQL, a rule that evaluates to NULL is satisfied.
    """
    names = list(checks)
    counts = table.agg(*[F.count_if(~checks[n]).alias(f"_{i}") for i, n in enumerate(names)])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, n in enumerate(names)]))
    return counts.select(pairs.alias("_pair")).select("_pair.rule", "_pair.violations")


def unique_violations(table: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Number of key values used more than once (rows with a NULL key are exempt)."""
    repeated = (table.dropna(subset=list(keys)).groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations")


def reference_violations(table: DataFrame, column: str, referenced: DataFrame,
                         referenced_column: str, rule: str) -> DataFrame:
    """Rows whose non-NULL reference is absent from the referenced table.

    Rows are first counted per reference value, so a busy value costs one row.
    """
    counted = (table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref"))
               .agg(F.count(F.lit(1)).alias("_n")))
    known = referenced.select(F.col(referenced_column).alias("_ref"))
    orphans = counted.join(known, "_ref", "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations")


def unknown_values(table: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Stored texts outside their state set, with row counts."""
    return (table.filter(~F.col(column).isin(*allowed)).groupBy(column)
            .agg(F.count(F.lit(1)).alias("rows")))
