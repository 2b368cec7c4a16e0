"""Row numbers along a sort order, whatever the size of a group.

The rows are range-partitioned once by group and order, sorted where they lie, and written
with their place.  Only one count per partition is carried over the borders, so a group may
fill any number of partitions, and rows of one second are as good as rows of one year.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.lineage import cut
from sluice.operators.skew import lookup

# A place is the partition's number above this bit and the row's number below it.
PLACE_BITS = 33


def dense_index(rows: DataFrame, keys: Sequence[str], keep: Sequence[str] | None = None,
                index: str = "index") -> DataFrame:
    """``keep`` columns (all by default) and the rows' 0-based number in the order of ``keys``.

    Rows with equal keys stay together in one partition, in any order.
    """
    keep = list(rows.columns if keep is None else keep)
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .select(*keep, F.monotonically_increasing_id().alias("_place")), "ranges")
    part = F.shiftright("_place", PLACE_BITS).cast("int")
    # One number per partition reaches the driver.
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy(part.alias("_part")).agg(
        F.count(F.lit(1)).alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    bases = rows.sparkSession.createDataFrame(
        [(p, base) for (p, _), base in zip(sizes, starts)], "_part int, _base bigint")
    within = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
            .select(*keep, (F.col("_base") + within).alias(index)))


def number_by_range(rows: DataFrame, group: Sequence[str], order: Sequence[str],
                    number: str = "number") -> DataFrame:
    """1-based number of each row within its group; NULL where the group is NULL."""
    indexed = dense_index(rows, [*group, *order], index="_index")
    first = indexed.groupBy(*group).agg(F.min("_index").alias("_first"),
                                        F.count(F.lit(1)).alias("_n"))
    found = lookup(indexed, first, group, spread=["_index"])
    return (found.withColumn(number, (F.col("_index") - F.col("_first") + 1).cast("bigint"))
            .drop("_index", "_first"))
