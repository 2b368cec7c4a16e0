"""Joins, ranks and row numbers that stay balanced when one key is huge.

A third of all rows may carry one key.  Three helpers cover the cases where a
plain join or window would send that key to one task:

* ``lookup``       left join of many rows to one row per key
* ``first_n``      the first n rows of every group
* ``number_rows``  a dense row number for every row of every group
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The heaviest keys are answered from a broadcast of at most this many rows.
# No other key can then hold more than 1/(HOT_KEYS + 1) of the rows.
HOT_KEYS = 256
# Rows that are already answered are spread over this many salts.
SPREAD = 4096


def lookup(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str],
           weights: DataFrame | None = None) -> DataFrame:
    """Left join ``rows`` to ``per_key``, which has one row per value of ``keys``.

    ``spread`` names columns of ``rows`` that vary within a key.  Row counts per
    key come from a column ``_n`` of ``per_key`` if it has one (it is an
    aggregate of ``rows``), else from ``weights`` (``keys`` and ``_n``), else
    from a count of ``rows``.

    Rows of the heaviest keys, and rows with a NULL key, never meet in one task:
    the former are answered from a broadcast of at most ``HOT_KEYS`` rows, and
    both go through the shuffled join under a salt that matches nothing.
    """
    keys = list(keys)
    values = [c for c in per_key.columns if c not in (*keys, "_n")]
    value = F.struct(*values).alias("_value")
    heavy_first = [F.desc("_n"), *keys]
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    # The join implies this filter; stating it keeps both uses of the aggregate
    # identical, so that one shuffle serves them.
    per_key = per_key.filter(~null_key)
    if "_n" in per_key.columns:
        ranked = per_key.orderBy(*heavy_first).limit(HOT_KEYS)
        hot_values = ranked.select(*keys, value)
    else:
        if weights is None:
            weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        heaviest = (weights.filter(~null_key).orderBy(*heavy_first).limit(HOT_KEYS)
                    .select(*keys))
        found = per_key.select(*keys, value).join(F.broadcast(heaviest), keys, "left_semi")
        hot_values = heaviest.join(F.broadcast(found), keys, "left")
    hot = F.broadcast(hot_values.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_value").alias("_hot_value"),
        F.lit(True).alias("_is_hot")))
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & (F.col(k) == F.col(f"_hot_{k}"))
    answered = F.col("_is_hot").isNotNull() | null_key
    salt = F.when(answered, F.pmod(F.xxhash64(*spread), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    tagged = rows.join(hot, same_key, "left").withColumn("_salt", salt.cast("bigint"))
    # Always 0, but not a literal: a literal would be taken out of the join key.
    # Never NULL, or the join would add a filter and undo the shared shuffle.
    zero = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(1)).cast("bigint"), F.lit(0))
    cold = per_key.select(*keys, value, zero.alias("_salt"))
    joined = tagged.join(cold, [*keys, "_salt"], "left")
    answer = F.coalesce(F.col("_hot_value"), F.col("_value"))
    return joined.select(*rows.columns, *[answer[v].alias(v) for v in values])


def first_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
            spread: Sequence[str], ways: int = 64, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Salted first round: every group is cut to at most ``ways * n`` rows before
    any task sees the whole group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(ways)))
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    finalists = (salted.withColumn("_rank", F.row_number().over(local))
                 .filter(F.col("_rank") <= n).drop("_rank", "_salt"))
    return (finalists.withColumn(rank, F.row_number().over(whole))
            .filter(F.col(rank) <= n))


def number_rows(rows: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column],
                number: str = "number") -> DataFrame:
    """Dense 1-based number of each row within its group.

    ``bucket`` must not decrease along ``order`` (a day of a timestamp, a block
    of a row index).  Rows are numbered per bucket; bucket sizes are summed up
    along each group and added.  A group larger than a bucket is thus numbered
    by many tasks.
    """
    bucketed = rows.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket",
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_local", F.row_number().over(within))
    return (numbered.join(offsets, [*group, "_bucket"])
            .withColumn(number, (F.col("_local") + F.col("_offset")).cast("bigint"))
            .drop("_bucket", "_local", "_offset"))
