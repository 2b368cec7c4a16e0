"""Evaluate costly expressions once.

A filter on a computed column is pushed below the projection that computes it,
and the expression with everything it refers to is copied into the filter.  For
rule chains and tokenised text the copies multiply.  An array of one struct
that is inlined again yields the same row, and filters on its fields stay above
it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(rows: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` columns as they are, then each computed column, evaluated once per row."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return rows.select(*keep, F.inline_outer(packed))
