"""Patterns, Arrow batches and key expressions the text operators share."""

from __future__ import annotations

import gc
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import lineage
from sluice.session import tune

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Texts may be long: keep the Arrow batches that reach Python workers small.
ROWS_PER_BATCH = 500
BYTES_PER_BATCH = 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the package plus bounded Arrow batches."""
    tune(spark)
    # Where the package lies at the same path for executors, Python workers find it.
    spark.sparkContext.environment.setdefault("PYTHONPATH",
                                              str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffles are then freed.

    Spark's cleaner deletes the shuffle files of plans that the driver has collected as
    garbage.  A driver with a large heap may not get to that between many steps, so it
    is asked to.
    """
    written = lineage.cut(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# Bits of the fixed-size bitmaps that thin out a scan before an exact join.
BITMAP_BITS = 1 << 22


def bitmap(rows: DataFrame, loc: Column, label: str) -> Column:
    """A bitmap over the hashes ``loc`` of ``rows``, as one array of BITMAP_BITS / 64 longs.

    Its size does not depend on the rows; with many of them it only lets more through.
    """
    spark = rows.sparkSession
    words = (rows.select(F.pmod(loc, F.lit(BITMAP_BITS)).alias("p"))
             .select(F.shiftright("p", 6).cast("int").alias("w"),
                     F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
             .groupBy("w").agg(F.bit_or("bit").alias("bits")))
    whole = spark.range(BITMAP_BITS // 64).select(F.col("id").cast("int").alias("w")).join(
        words, "w", "left")
    pair = F.struct("w", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    packed = whole.agg(F.transform(F.array_sort(F.collect_list(pair)),
                                   lambda x: x["bits"]).alias("m"))
    return cut(packed, label).scalar()


def in_bitmap(rows: DataFrame, loc: Column, bits: Column) -> DataFrame:
    """The rows whose hash ``loc`` is set in the bitmap, and perhaps some others."""
    spot, word = unused(rows, "spot"), unused(rows, "bits")
    place = F.pmod(loc, F.lit(BITMAP_BITS))
    marked = rows.withColumn(spot, place).withColumn(
        word, F.element_at(bits, F.shiftright(place, 6).cast("int") + 1))
    return (marked.filter(F.expr(f"shiftright({word}, cast({spot} & 63 as int)) & 1") == 1)
            .drop(spot, word))
