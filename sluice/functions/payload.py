"""Flat JSON payloads carried by jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_POLICY_SCHEMA = ("struct<max_attempts double, initial_backoff_ms double, "
                       "max_backoff_ms double, backoff_multiplier double>")


def payload_json(*fields: Column) -> Column:
    """Flat JSON object of string fields; NULL fields are left out."""
    return F.to_json(F.struct(*fields))


def payload_field(payload: Column, key: str) -> Column:
    """String field of a flat payload; NULL when absent or not a string."""
    is_text = payload.rlike(f'"{key}"[ \\t]*:[ \\t]*"')
    return F.when(is_text, F.get_json_object(payload, f"$.{key}"))


def payload_best_effort(payload: Column, key: str) -> Column:
    """Any field as text; NULL when the payload is not a JSON object."""
    return F.get_json_object(payload, f"$.{key}")


def retry_policy_parse(policy: Column) -> Column:
    """Policy struct, or NULL when any of the four numbers is missing."""
    p = F.from_json(policy, RETRY_POLICY_SCHEMA)
    complete = (p.max_attempts.isNotNull() & p.initial_backoff_ms.isNotNull()
                & p.max_backoff_ms.isNotNull() & p.backoff_multiplier.isNotNull())
    return F.when(complete, F.struct(
        p.max_attempts.cast("int").alias("max_attempts"),
        p.initial_backoff_ms.cast("bigint").alias("initial_backoff_ms"),
        p.max_backoff_ms.cast("bigint").alias("max_backoff_ms"),
        p.backoff_multiplier.alias("backoff_multiplier")))


def retry_policy_json(policy: Column) -> Column:
    return F.to_json(policy)
