"""From free-form column labels to the canonical columns of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.operators.barrier import compute_once
from sluice.plans.targets import Field, Target


def _label(col: Column) -> Column:
    return fn.ascii_lower(fn.trim_header(col))


def field_by_aliases(labels: Column, values: Column, field: Field) -> Column:
    """Value under the first label, in byte order of raw labels, that names ``field``."""
    places = [F.nullif(F.array_position(labels, alias), F.lit(0)) for alias in field.aliases]
    return F.try_element_at(values, F.least(*places).cast("int"))


def align_maps(records: DataFrame, target: Target, fields: str = "fields") -> DataFrame:
    """Replace a map column of raw fields by the target's string columns.

    A column no label of the record maps to is NULL, unlike a blank value.
    """
    rest = [c for c in records.columns if c != fields]
    sorted_entries = compute_once(records, rest, {
        "_entries": F.sort_array(F.map_entries(fields))})
    read = compute_once(sorted_entries, rest, {
        "_labels": F.transform("_entries", lambda e: _label(e["key"])),
        "_values": F.col("_entries.value")})
    return compute_once(read, rest, {
        f.name: field_by_aliases(F.col("_labels"), F.col("_values"), f) for f in target.fields})


def align_exact(records: DataFrame, target: Target, fields: str = "fields") -> DataFrame:
    """As ``align_maps`` but only the canonical names themselves count."""
    rest = [c for c in records.columns if c != fields]
    return records.select(
        *rest, *[F.try_element_at(F.col(fields), F.lit(f.name)).alias(f.name)
                 for f in target.fields])


def align_columns(records: DataFrame, target: Target, keep: list[str]) -> DataFrame:
    """Resolve the labels of a wide table once, at plan time.

    ``keep`` lists columns that are not data (ids, row numbers).
    """
    labels = sorted((c for c in records.columns if c not in keep), key=lambda c: c.encode())
    chosen = []
    for field in target.fields:
        hit = next((c for c in labels
                    if c.strip(fn.text.HEADER_WHITESPACE).lower() in field.aliases), None)
        source = F.col(f"`{hit}`") if hit is not None else F.lit(None)
        chosen.append(source.cast("string").alias(field.name))
    return records.select(*keep, *chosen)
