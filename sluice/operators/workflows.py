"""Workflow read models: steps in order and the steps they depend on.

Both are flat rows, so a workflow may have any number of steps and a step any
number of dependencies.  The nested document is built for the workflows of one
page only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.skew import lookup


def workflow_steps(workflows: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per step of the wanted workflows.

    ``steps`` is (id, workflow_id, job_id, name, position).
    """
    wanted = workflows.select(F.col("id").alias("workflow_id"), F.lit(True).alias("_wanted"))
    return (lookup(steps, wanted, ["workflow_id"], spread=["id"]).filter("_wanted")
            .drop("_wanted").withColumnRenamed("id", "step_id"))


def step_dependencies(workflows: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per dependency of a wanted workflow's step, with the step's place.

    ``edges`` is (step_id, depends_on_step_id) with unique pairs.
    """
    places = workflow_steps(workflows, steps).select("step_id", "workflow_id", "position")
    found = lookup(edges, places, ["step_id"], spread=["depends_on_step_id"])
    return found.filter(F.col("workflow_id").isNotNull())


def workflow_documents(page: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Nested read model of the workflows of one page: id and ``steps`` by position.

    ``page`` holds the few workflows that are shown; each document is one row,
    as large as its workflow.
    """
    depends = step_dependencies(page, steps, edges).groupBy("step_id").agg(
        F.array_sort(F.collect_list("depends_on_step_id")).alias("depends_on"))
    detailed = workflow_steps(page, steps).join(depends, "step_id", "left")
    empty = F.array().cast(depends.schema["depends_on"].dataType)
    entry = F.struct("position", "step_id", "name", "job_id",
                     F.coalesce("depends_on", empty).alias("depends_on"))
    nested = detailed.groupBy(F.col("workflow_id").alias("id")).agg(
        F.array_sort(F.collect_list(entry)).alias("steps"))
    none = F.array().cast(nested.schema["steps"].dataType)
    return page.join(nested, "id", "left").withColumn("steps", F.coalesce("steps", none))
