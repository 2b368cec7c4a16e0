"""Counters, gauges and histograms over ``(name, kind, value, ts)`` samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter_sum(samples: DataFrame) -> DataFrame:
    return (samples.filter(F.col("kind") == "counter").groupBy("name")
            .agg(F.sum("value").alias("value")))


def gauge_last(samples: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest value per name; ``order`` should break ties."""
    return (samples.filter(F.col("kind") == "gauge").groupBy("name")
            .agg(F.max_by("value", F.struct(*order)).alias("value")))


def histogram_stats(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("kind") == "histogram").groupBy("name").agg(
        F.count("value").alias("count"), F.sum("value").alias("sum"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def metrics_render(samples: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``(section, name, value)``: counters, gauges, then histogram figures.

    Sort by ``section, family, part`` for the text form; one line per row.
    """
    def lines(section: int, table: DataFrame) -> DataFrame:
        return table.select(F.lit(section).alias("section"), F.col("name").alias("family"),
                            F.lit(0).alias("part"), "name",
                            F.col("value").cast("double").alias("value"))

    stats = histogram_stats(samples)
    figures = stats.select(
        F.lit(3).alias("section"), F.col("name").alias("family"),
        F.posexplode(F.array(*[
            F.struct(F.concat(F.col("name"), F.lit(f"_{figure}")).alias("name"),
                     F.col(figure).cast("double").alias("value"))
            for figure in ("count", "sum", "min", "max")])).alias("part", "_line"))
    histograms = (figures.select("section", "family", "part", "_line.name", "_line.value")
                  .filter(F.col("value").isNotNull()))
    return (lines(1, counter_sum(samples)).unionByName(lines(2, gauge_last(samples, order)))
            .unionByName(histograms))


def metrics_text(samples: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The rendered lines in order."""
    return (metrics_render(samples, order).orderBy("section", "family", "part")
            .select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("line")))
