"""JSON request bodies: record batches and workload items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.operators.barrier import compute_once
from sluice.plans.targets import TARGETS

# The service's own limits.  Nothing applies them unless a caller asks for limits.
MAX_RECORDS = 1000
MAX_ITEMS = 1000
MAX_ITEM_BYTES = 64 * 1024
MAX_TYPE_BYTES = 128


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``(submission_id, body)``, one request body per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("submission_id"), F.col("value").alias("body"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _member(body: Column, key: str) -> Column:
    return F.try_variant_get(body, f"$.{key}", "variant")


def json_records(bodies: DataFrame, max_records: int | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Records of each body, and the refused bodies with their reason.

    A body is an object with ``target`` and a non-empty array ``records`` of
    flat objects whose values are all strings, at most ``max_records`` if given.
    """
    many = F.lit(False) if max_records is None else F.size("_items") > max_records
    parsed = bodies.select("submission_id", F.try_parse_json("body").alias("_body"))
    opened = parsed.select(
        "submission_id", "_body", _member(F.col("_body"), "target").alias("_target"),
        F.try_variant_get("_body", "$.records", "array<variant>").alias("_items"))
    items = F.transform("_items", lambda i: F.try_variant_get(i, "$", "map<string,variant>"))
    read = opened.withColumn("_records", items)
    # Names of non-string fields, per record in order.
    wrong = F.flatten(F.transform("_records", lambda m: F.map_keys(
        F.map_filter(m, lambda k, v: v.isNull() | (_kind(v) != "STRING")))))
    checked = read.withColumn("_wrong", F.when(
        ~F.exists("_records", lambda m: m.isNull()), wrong))
    target_text = F.try_variant_get("_target", "$", "string")
    reason = (
        F.when(F.col("_body").isNull() | ~_kind(F.col("_body")).startswith("OBJECT"),
               F.lit("request body must be a JSON object"))
        .when(F.col("_target").isNull() | (_kind(F.col("_target")) != "STRING"),
              F.lit("'target' must be a string"))
        .when(~target_text.isin(*TARGETS), F.concat(
            F.lit("unrecognized 'target' value '"), target_text, F.lit("'")))
        .when(F.col("_items").isNull() | (F.size("_items") == 0),
              F.lit("'records' must be a non-empty array"))
        .when(F.exists("_records", lambda m: m.isNull()),
              F.lit("each element of 'records' must be an object"))
        .when(F.size("_wrong") > 0, F.concat(
            F.lit("each record field must be a string (field '"),
            F.try_element_at("_wrong", F.lit(1)), F.lit("' is not)")))
        .when(many, F.lit(f"at most {max_records} records may be confirmed at once")))
    judged = compute_once(checked, ["submission_id"], {
        "target": target_text, "_records": F.col("_records"), "reason": reason})
    good = judged.filter(F.col("reason").isNull()).select(
        "submission_id", "target", F.posexplode("_records").alias("_position", "_map"))
    records = good.select(
        "submission_id", "target", (F.col("_position") + 1).cast("bigint").alias("row_index"),
        F.transform_values("_map", lambda k, v: F.try_variant_get(v, "$", "string"))
        .alias("fields"))
    refused = judged.filter(F.col("reason").isNotNull()).select("submission_id", "reason")
    return records, refused


def json_items(bodies: DataFrame, max_items: int | None = None,
               max_item_bytes: int | None = None, max_type_bytes: int | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """Items of each workload request, and the refused requests.

    Text items are payloads as they are; any other JSON is written out.  Each
    limit applies if it is given.
    """
    never = F.lit(False)
    long_type = never if max_type_bytes is None else fn.longer_than(F.col("type"), max_type_bytes)
    many = never if max_items is None else F.size("payloads") > max_items
    long_item = never if max_item_bytes is None else F.exists(
        "payloads", lambda p: F.octet_length(p) > max_item_bytes)
    parsed = bodies.select("submission_id", F.try_parse_json("body").alias("_body"))
    opened = parsed.select(
        "submission_id", "_body", _member(F.col("_body"), "type").alias("_type"),
        _member(F.col("_body"), "items").alias("_items"))
    as_array = F.try_variant_get("_items", "$", "array<variant>")
    payload = F.transform(as_array, lambda v: F.when(
        _kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))
    type_text = F.try_variant_get("_type", "$", "string")
    read = opened.select("submission_id", "_body", "_type", "_items",
                         type_text.alias("type"), payload.alias("payloads"))
    reason = (
        F.when(F.col("_body").isNull() | ~_kind(F.col("_body")).startswith("OBJECT"),
               "request body must be a JSON object")
        .when(F.col("_type").isNull() | (_kind(F.col("_type")) != "STRING"),
              "'type' must be a string")
        .when(F.col("_items").isNotNull() & F.col("payloads").isNull(),
              "'items' must be an array")
        .when(F.col("type") == "", "type must not be empty")
        .when(long_type, f"type must be <= {max_type_bytes} characters")
        .when(many, f"items must contain <= {max_items} entries")
        .when(F.exists("payloads", lambda p: p == ""), "every item payload must not be empty")
        .when(long_item, f"every item payload must be <= {max_item_bytes} bytes"))
    judged = compute_once(read, ["submission_id", "type", "payloads"], {"reason": reason})
    items = (judged.filter(F.col("reason").isNull())
             .select("submission_id", "type", F.posexplode("payloads")
                     .alias("_position", "payload"))
             .select("submission_id", "type", (F.col("_position") + 1).cast("bigint")
                     .alias("row_index"), "payload"))
    refused = judged.filter(F.col("reason").isNotNull()).select("submission_id", "reason")
    return items, refused
