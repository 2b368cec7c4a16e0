"""The JSON document of a preview, one per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.operators.paging import json_document
from sluice.operators.skew import first_n
from sluice.operators.validate import MAX_REPORTED
from sluice.plans.submission import Preview
from sluice.plans.targets import Target

# A document lists at most this many records; its counts are exact.
MOST_RECORDS = 1000


def preview_documents(plan: Preview, source: str, target: Target, records: int = MOST_RECORDS,
                      rejects: int = MAX_REPORTED) -> DataFrame:
    """``(submission_id, document)``: counts, the first records and rejects, warnings, confidence.

    Structural rejects come before those of the mapping, each in row order.
    """
    listed = first_n(plan.records, ["submission_id"], [F.col("row_index")], records,
                     spread=["row_index"], rank="_nth")
    record = F.try_parse_json(fn.payload_json(*target.payload()))
    shown = listed.select("submission_id", "_nth", F.to_json(record).alias("_text")).groupBy(
        "submission_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "_text"))).alias("_r"))
    late = (F.col("stage") == "mapping").cast("int")
    bad = first_n(plan.rejects.withColumn("_late", late), ["submission_id"],
                  [F.col("_late"), F.col("row_index")], rejects, spread=["row_index"], rank="_nth")
    refused = bad.groupBy("submission_id").agg(F.array_sort(F.collect_list(
        F.struct("_nth", F.col("row_index").alias("index"), "reason"))).alias("_bad"))
    whole = plan.summary.join(shown, "submission_id", "left").join(refused, "submission_id", "left")
    if plan.notes is None:
        whole = whole.withColumns({"warning": F.lit(None).cast("string"),
                                   "average_confidence": F.lit(None).cast("double")})
    else:
        whole = whole.join(plan.notes, "submission_id", "left")
    items = F.transform(F.coalesce("_r", F.array()), lambda r: F.try_parse_json(r["_text"]))
    lost = F.transform(F.coalesce("_bad", F.array()),
                       lambda r: F.struct(r["index"].alias("index"), r["reason"].alias("reason")))
    return whole.select("submission_id", json_document(
        F.lit(source).alias("source"), F.lit(target.name).alias("target"), "total_records",
        "valid_records", "invalid_records", items.alias("records"), lost.alias("rejected_records"),
        (F.col("invalid_records") > rejects).alias("rejected_records_truncated"),
        F.array_compact(F.array("warning")).alias("warnings"),
        "average_confidence").alias("document"))
