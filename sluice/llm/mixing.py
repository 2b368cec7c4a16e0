"""Mix sources to target weights: repeat or thin out documents by source.

Tokens (words) are summed per source; every source gets a target share of the
whole; its repetition rate is target / size.  A document is emitted
floor(rate) times, plus once more when a hash of seed and doc_id, read as a
number in [0, 1), is below the rate's fraction.

Plain DataFrame work: one partially aggregated sum per source (a source with a
third of all rows costs one row per task), windows over the table of sources
(one row each, not one per document), and one join back on the source.  The
table of sources is written to the shared folder first, so Spark knows its true
size and broadcasts it only below its own threshold; beyond, the join shuffles
and adaptive execution splits a hot source.

Defined cases: NULL text has size 0; NULL source is a source of its own, last in
order; sources whose sizes sum to 0 get target 0 and no copies; NULL doc_id draws as
the text ``null``; repeated rows draw alike, so reruns agree; an empty table
gives an empty mix; further columns pass through, also when they share names
with the working columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, unused, word_count

WEIGHTS = (1, 2, 3)
SEED = "mix-1"
# The draw takes 12 hexadecimal digits of an MD5 sum.
DIGITS = 12


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
                   most: float = 3.0) -> DataFrame:
    """Targets from one row per source (``source``, ``source_size``).

    Sources ordered by code point, NULL last, take ``weights`` in turn.  Targets
    are proportional to weight and sum to ``share`` of all sizes, but stop at
    ``most`` times the source's size; the excess is reshared by weight until none
    is above.  That is a water level L with target = min(most * size, L * weight):
    sources fill up in the order of cap / weight, and L is what is left of the words
    over what is left of the weights at the first source that does not fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    named = (sizes.withColumn("_weight", weight)
             .withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    fill = F.col("_cap") / F.col("_weight")
    before = Window.orderBy(fill, F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(
        F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(whole) - F.coalesce(
        F.sum("_weight").over(before), F.lit(0.0))
    levels = named.withColumn("_level", left / weight_left)
    # Levels rise while sources fill up and fall after that: the highest is the one.
    target = F.least("_cap", F.max("_level").over(whole) * F.col("_weight"))
    return (levels.withColumn("target", target)
            .select("source", "source_size", "target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(text.cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** DIGITS))


def plan_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
                most: float = 3.0, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with its size, its source's figures and its copies.

    The added columns' names (they avoid those of ``docs``) are returned beside
    the rows, under the keys size, source_size, target and copies.
    """
    name = {k: unused(docs, k) for k in ("size", "source_size", "target", "copies")}
    key = unused(docs, "mix_source")
    sized = docs.withColumn(name["size"], word_count(F.col("text")))
    sizes = (docs.select("source", word_count(F.col("text")).alias("size"))
             .groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    targets = cut(source_targets(sizes, weights, share, most), "mix").select(
        F.col("source").alias(key), F.col("source_size").alias(name["source_size"]),
        F.col("target").alias(name["target"]))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    size = F.col(name["source_size"])
    rate = F.when(size > 0, F.col(name["target"]) / size).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.withColumn(name["copies"], F.floor(rate) + extra), name


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
        most: float = 3.0, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say."""
    planned, name = plan_copies(docs, weights, share, most, seed)
    copy = unused(planned, "copy")
    return (planned.filter(F.col(name["copies"]) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int"))))
            .select(*[F.col(c) for c in docs.columns]))
