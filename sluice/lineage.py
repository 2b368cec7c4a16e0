"""Cutting lineage between rounds of an iterative job.

The cut is a parquet table in the shared folder named by
``spark.checkpoint.dir``: it survives the loss of executors, is computed once,
and gives the next round real size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice import files


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{shared_dir(spark)}/sluice-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "round") -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(frame: DataFrame) -> None:
    """Delete what ``cut`` wrote, once everything made from it is written elsewhere."""
    folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[1].startswith("sluice-"):
            files.delete(frame.sparkSession, folder)


def counted_cut(df: DataFrame, label: str, count: Column) -> tuple[DataFrame, int]:
    """As ``cut``; also the value of an aggregate over the rows, taken while they are written."""
    seen = Observation()
    written = cut(df.observe(seen, F.coalesce(count, F.lit(0)).alias("n")), label)
    return written, seen.get.get("n") or 0
