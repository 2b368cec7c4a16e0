"""Rule chains: every row gets the first failing rule as its reject reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.barrier import compute_once
from sluice.operators.skew import first_n
from sluice.plans.targets import CATEGORIES, PRODUCTS, USERS, Target

MAX_REPORTED = 200


def missing_column_rules(target: Target) -> list:
    return [(F.col(c).isNull(), F.lit(f"no '{c}' column could be found for this record"))
            for c in target.required]


def required_rule(target: Target) -> list:
    """The single rule of the confirm step for absent required fields."""
    names = [f"'{c}'" for c in target.required]
    text = {1: f"{names[0]} is required"}.get(len(names))
    if text is None:
        comma = "," if len(names) > 2 else ""
        text = f"{', '.join(names[:-1])}{comma} and {names[-1]} are required"
    absent = F.lit(False)
    for c in target.required:
        absent = absent | F.col(c).isNull()
    return [(absent, F.lit(text))]


def first_reason(rules: list) -> Column:
    return F.coalesce(*[F.when(failed, reason) for failed, reason in rules])


def annotate(rows: DataFrame, target: Target, strict: bool = False) -> DataFrame:
    """Normalise the target's columns and add ``reason`` (NULL when valid).

    An existing non-NULL ``reason`` is kept.  ``strict`` uses the confirm
    step's wording for absent required columns.
    """
    leading = required_rule(target) if strict else missing_column_rules(target)
    rest = [c for c in rows.columns if c not in target.columns and c != "reason"]
    absent = rows.withColumn("_absent", first_reason(leading))
    normal = target.normalize(absent)
    found = F.coalesce(F.col("_absent"), first_reason(target.rules()))
    if "reason" in rows.columns:
        found = F.coalesce(F.col("reason"), found)
    return compute_once(normal, rest, {**{c: F.col(c) for c in target.columns},
                                       "reason": found})


def validate_users(rows: DataFrame) -> DataFrame:
    return annotate(rows, USERS)


def validate_products(rows: DataFrame) -> DataFrame:
    return annotate(rows, PRODUCTS)


def validate_categories(rows: DataFrame) -> DataFrame:
    return annotate(rows, CATEGORIES)


def split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the ``(submission, row, reason)`` rows of the others."""
    accepted = annotated.filter(F.col("reason").isNull()).drop("reason")
    rejected = (annotated.filter(F.col("reason").isNotNull())
                .select("submission_id", "row_index", "reason"))
    return accepted, rejected


def bounded_rejects(rejects: DataFrame, limit: int = MAX_REPORTED) -> DataFrame:
    """The first ``limit`` rejects of each submission, in row order."""
    return first_n(rejects, ["submission_id"], [F.col("row_index")], limit,
                   spread=["row_index"], rank="position")


def reject_totals(rejects: DataFrame, limit: int = MAX_REPORTED) -> DataFrame:
    """Exact reject count per submission, and whether the report is cut short."""
    counts = rejects.groupBy("submission_id").agg(F.count(F.lit(1)).alias("rejected"))
    return counts.withColumn("truncated", F.col("rejected") > limit)


def reject_union(structural: DataFrame, mapping: DataFrame) -> DataFrame:
    """Structural rejects and mapping rejects, tagged with their stage."""
    columns = ["submission_id", "row_index", "reason"]
    return (structural.select(F.lit("structural").alias("stage"), *columns)
            .unionByName(mapping.select(F.lit("mapping").alias("stage"), *columns)))
