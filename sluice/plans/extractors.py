"""Source types and the reader that turns each into records.

``register_extractor`` adds a reader for a new source type.  A reader takes a
session, a path and its own optional limits and returns an ``Extraction``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.status import SOURCE_TYPES
from sluice.operators.barrier import compute_once
from sluice.sources import csv, ocr
from sluice.sources.images import image_admission


@dataclass(frozen=True)
class Extraction:
    """Records (with row reasons), refused submissions, per-submission notes."""

    records: DataFrame
    refused: DataFrame
    notes: DataFrame | None = None


Extractor = Callable[..., Extraction]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(source_type: str, extractor: Extractor) -> None:
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type '{source_type}'")
    if source_type in _EXTRACTORS:
        raise ValueError(f"an extractor is already registered for '{source_type}'")
    _EXTRACTORS[source_type] = extractor


def extract(spark: SparkSession, source_type: str, path: str, **options) -> Extraction:
    """Read ``path``; ``options`` (none by default) go to the source's reader."""
    if source_type not in _EXTRACTORS:
        raise KeyError(f"source '{source_type}' is not yet supported")
    return _EXTRACTORS[source_type](spark, path, **options)


def _csv(spark: SparkSession, path: str, max_bytes: int | None = None,
         max_rows: int | None = None) -> Extraction:
    if max_bytes is None and max_rows is None:
        return Extraction(*csv.extract_csv_split(spark, path))
    files = csv.read_files(spark, path, max_bytes)
    return Extraction(*csv.extract_csv(files, max_bytes=max_bytes, max_rows=max_rows))


def _words(spark: SparkSession, path: str, max_rows: int | None = None,
           images: str | None = None) -> Extraction:
    """Word tables of images; with ``images``, the folder of the image files themselves.

    A word table and its image have the same name but for the extension.  An image that is
    not admitted refuses its table, whatever the words say.
    """
    files = ocr.read_word_files(spark, path)
    if images is None:
        return Extraction(*ocr.extract_ocr(ocr.ocr_word_scan(files), files, max_rows))
    stem = F.regexp_extract(F.col("submission_id"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    checked = image_admission(csv.read_files(spark, images)).select(
        stem.alias("_stem"), F.col("reason").alias("_refusal"))
    judged = files.withColumn("_stem", stem).join(checked, "_stem", "left")
    judged = compute_once(judged, ["submission_id", "tsv"], {"_refusal": F.col("_refusal")})
    admitted = judged.filter(F.col("_refusal").isNull()).drop("_refusal")
    records, refused, notes = ocr.extract_ocr(ocr.ocr_word_scan(admitted), admitted, max_rows)
    return Extraction(records, refused.unionByName(judged.filter(
        F.col("_refusal").isNotNull()).select("submission_id", F.col("_refusal").alias("reason"))),
        notes)


register_extractor("csv", _csv)
register_extractor("image", _words)
register_extractor("screenshot", _words)
