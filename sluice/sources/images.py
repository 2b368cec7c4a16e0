"""Admission of image files by size and signature; no pixels are decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IMAGE_BYTES = 6 * 1024 * 1024


def image_format(content: Column) -> Column:
    """png, jpeg or webp by leading bytes, else NULL."""
    # The signatures of the three formats.
    head = F.hex(F.substring(content, 1, 12))
    return (F.when(head.startswith("89504E470D0A1A0A"), "png")
            .when(head.startswith("FFD8FF"), "jpeg")
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"),
                  "webp"))


def image_admission(files: DataFrame, max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Manifest of ``(submission_id, content)`` files: format, bytes, reason."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    detected = image_format(F.col("content"))
    reason = (F.when(size == 0, "image upload is empty")
              .when(size > max_bytes, f"image upload must be <= {max_bytes} bytes")
              .when(detected.isNull(),
                    "unsupported or corrupt image -- only PNG, JPEG, and WebP are supported"))
    return files.select("submission_id", size.cast("bigint").alias("bytes"),
                        F.when(reason.isNull(), detected).alias("format"),
                        reason.alias("reason"))
