"""Category trees stored as (slug, parent_slug): chains, children, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.lineage import counted_cut, cut
from sluice.operators.skew import lookup

# A chain may name at most this many ancestors above the direct parent.
MAX_DEPTH = 64


def path_limit(max_depth: int) -> int:
    """Ancestors worth remembering: one more than the last one that may be looked at."""
    return max_depth + 2


def ancestor_paths(tree: DataFrame, limit: int = path_limit(MAX_DEPTH)) -> DataFrame:
    """Ancestors of every slug, nearest first, by path doubling.

    ``tree`` has unique ``slug`` and ``parent_slug``.  Adds ``path`` (at most
    ``limit`` slugs) and ``ended``: ``root``, ``missing`` (the last slug of the
    path is not in the tree) or NULL for a chain still open at the limit.
    Each round doubles the known path, so ``limit`` 66 takes seven rounds.  Only
    slugs that are somebody's parent take part in the rounds, and of those only
    the ones with an open chain; leaves are answered by one lookup at the end.
    """
    parents = (tree.filter(F.col("parent_slug").isNotNull())
               .groupBy(F.col("parent_slug").alias("slug")).agg(F.count(F.lit(1)).alias("_n")))
    rooted = F.col("parent_slug").isNull()
    none = F.array().cast("array<string>")
    start = tree.join(parents.select("slug"), "slug", "left_semi").select(
        "slug", "parent_slug", F.when(rooted, none).otherwise(F.array("parent_slug")).alias("path"),
        F.when(rooted, F.lit("root")).alias("ended"))
    inner = _doubled_paths(start, limit)
    above = inner.select(F.col("slug").alias("parent_slug"), F.col("path").alias("_more"),
                         F.col("ended").alias("_then"), F.lit(True).alias("_here"))
    weights = parents.withColumnRenamed("slug", "parent_slug")
    found = lookup(tree, above, ["parent_slug"], spread=["slug"], weights=weights)
    path = F.concat(F.array("parent_slug"), F.coalesce("_more", none))
    return found.select(
        *tree.columns, F.when(rooted, none).otherwise(F.slice(path, 1, limit)).alias("path"),
        F.when(rooted, "root").when(F.col("_here").isNull(), "missing")
        .when(F.size(path) <= limit, F.col("_then")).alias("ended"))


def _doubled_paths(start: DataFrame, limit: int) -> DataFrame:
    """Complete the paths of ``start`` from each other.

    A round writes the rows that were open before it and nothing else; rows that are closed
    stay in the table of the round that closed them.  Many rows may share an ancestor: the
    join is one that AQE splits where a key is heavy.
    """
    growing = F.col("ended").isNull() & (F.size("path") < limit)
    known, still_open = counted_cut(start, "paths", F.count_if(growing))
    closed: list[DataFrame] = []
    while still_open:
        before = [*closed, known]
        tails = before[0]
        for part in before[1:]:
            tails = tails.unionByName(part)
        tails = tails.select(F.col("slug").alias("_tip"), F.col("path").alias("_more"),
                             F.col("ended").alias("_then"), F.lit(True).alias("_here"))
        tipped = known.filter(growing).withColumn("_tip", F.element_at("path", -1))
        grown = tipped.join(tails, "_tip", "left")
        longer = F.slice(F.concat("path", F.coalesce(
            F.col("_more"), F.array().cast("array<string>"))), 1, limit)
        cut_short = F.size("path") + F.coalesce(F.size("_more"), F.lit(0)) > limit
        step = grown.select(
            "slug", "parent_slug", longer.alias("path"),
            F.when(F.col("_here").isNull(), F.lit("missing"))
            .when(~cut_short, F.col("_then")).alias("ended"))
        closed.append(known.filter(~growing))
        known, still_open = counted_cut(step, "paths", F.count_if(growing))
    for part in closed:
        known = known.unionByName(part)
    return known


def _first_repeat(chain: Column) -> Column:
    """1-based position in ``chain`` of the first slug seen before, else NULL.

    A chain that returns to a slug stays on that cycle, so everything before
    the first return is distinct and everything after it is known.
    """
    distinct = F.size(F.array_distinct(chain))
    return F.when(distinct < F.size(chain), distinct + 1)


def _judged(paths: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``paths`` with outcome, culprit and depth."""
    chain = F.concat(F.array("slug"), F.col("path"))
    # Position 1 is the slug itself, position d + 2 the ancestor at depth d.
    open_chain = F.col("ended").isNull()
    marked = paths.withColumn("_repeat", F.when(open_chain, _first_repeat(chain)))
    reachable = F.size("path") <= max_depth + 1
    outcome = (F.when((F.col("ended") == "root") & reachable, "ok")
               .when((F.col("ended") == "missing") & reachable, "missing")
               .when(F.col("_repeat") <= max_depth + 3, "cycle")
               .otherwise("too_deep"))
    culprit = (F.when(F.col("outcome") == "missing", F.element_at("path", -1))
               .when(F.col("outcome") == "cycle",
                     F.try_element_at(chain, F.col("_repeat").cast("int"))))
    depth = F.when(F.col("outcome") == "ok", F.size("path").cast("bigint"))
    return (marked.withColumn("outcome", outcome)
            .withColumns({"culprit": culprit, "depth": depth}).drop("_repeat"))


VERDICT = ("slug", "parent_slug", "outcome", "culprit", "depth")


def parent_chain_check(tree: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Verdict per category: ``ok``, ``missing``, ``cycle`` or ``too_deep``.

    ``culprit`` is the ancestor the verdict is about; ``depth`` the number of
    ancestors of a chain that reaches a root.  ``max_depth`` ancestors above the
    direct parent are allowed; the service's own rule is the default.
    """
    return _judged(ancestor_paths(tree, path_limit(max_depth)), max_depth).select(*VERDICT)


def outcome_message(outcome: Column, culprit: Column) -> Column:
    return (F.when(outcome == "missing", F.concat(
                F.lit("parent category '"), culprit,
                F.lit("' does not exist -- import it first, then re-import this record")))
            .when(outcome == "cycle", F.concat(
                F.lit("'parent_slug' (\""), culprit,
                F.lit("\") would create a cyclic parent relationship")))
            .when(outcome == "too_deep",
                  F.lit("parent category chain exceeds the maximum supported depth")))


def parent_in_submission(accepted: DataFrame) -> DataFrame:
    """Mark rows whose parent is another accepted record of their submission."""
    slugs = accepted.select("submission_id", F.col("slug").alias("parent_slug"),
                            F.lit(True).alias("_present"))
    marked = lookup(accepted, slugs, ["submission_id", "parent_slug"], spread=["slug"])
    return (marked.withColumn("parent_in_submission", F.coalesce("_present", F.lit(False)))
            .drop("_present"))


def hierarchy_resolve(stored: DataFrame, accepted: DataFrame,
                      max_depth: int = MAX_DEPTH) -> DataFrame:
    """Which accepted categories land, whatever the order they are applied in.

    ``stored`` and ``accepted`` have unique ``slug`` and ``parent_slug``.  An
    accepted record replaces the stored one of its slug; one that cannot land
    gives way to the stored record again, which may let its children land.
    Rounds only ever withdraw records, so they end; the usual case is one.  A round after
    the first one looks at the subtrees under withdrawn records alone.
    """
    limit = path_limit(max_depth)
    old = stored.select("slug", F.col("parent_slug").alias("_old_parent"), F.lit(True).alias("_old"))
    new = accepted.select("slug", "parent_slug", F.lit(True).alias("_new"))
    # One row per slug; ``replaces`` where an accepted record covers a stored one.
    tree = old.join(new, "slug", "full_outer").select(
        "slug", F.when(F.col("_new"), F.col("parent_slug")).otherwise(F.col("_old_parent"))
        .alias("parent_slug"), F.coalesce("_new", F.lit(False)).alias("live"),
        (F.col("_new") & F.col("_old")).alias("replaces"), "_old_parent")
    paths = ancestor_paths(cut(tree, "tree"), limit)
    failing = F.col("live") & F.col("replaces") & (F.col("outcome") != "ok")
    judged, open_ones = counted_cut(_judged(paths, max_depth), "judged", F.count_if(failing))
    settled = []
    while open_ones:
        withdrawn = cut(_unblocked(judged.filter(failing)), "withdrawn")
        settled.append(withdrawn.select(*VERDICT))
        changed, _ = counted_cut(_judged(_without(judged, withdrawn, limit), max_depth), "changed",
                                 F.count(F.lit(1)))
        # The rest of the tree stays where it was written.
        judged = judged.join(changed.select("slug"), "slug", "left_anti").unionByName(changed)
        open_ones = judged.filter(failing).count()
    result = judged.filter("live").select(*VERDICT)
    for part in settled:
        result = result.unionByName(part)
    return result


def _without(judged: DataFrame, withdrawn: DataFrame, limit: int) -> DataFrame:
    """New paths of the withdrawn slugs, as stored, and of all slugs below them.

    A path is kept up to its first withdrawn slug and goes on with that one's new path.
    """
    columns = ["slug", "parent_slug", "live", "replaces", "_old_parent", "path", "ended"]
    rows = judged.select(*columns)
    marks = withdrawn.select(F.col("slug").alias("_at"), F.lit(True).alias("_gone"))
    above = rows.select("slug", F.posexplode("path").alias("_pos", "_at"))
    hits = (above.join(marks, "_at").groupBy("slug")
            .agg(F.min(F.struct("_pos", "_at")).alias("_hit"))
            .select("slug", (F.col("_hit._pos") + 1).alias("_pos"), "_hit._at"))
    below = cut(rows.join(withdrawn.select("slug"), "slug", "left_anti").join(hits, "slug"), "below")
    # Paths of the withdrawn slugs: up to the next withdrawn one, then from each other.
    none = F.array().cast("array<string>")
    parent = F.col("_old_parent")
    first = rows.select(F.col("slug").alias("_old_parent"), F.col("path").alias("_p"),
                        F.col("ended").alias("_e"), F.lit(True).alias("_here"))
    stops = below.select(F.col("slug").alias("_old_parent"), "_pos")
    gone = withdrawn.select(F.col("slug").alias("_old_parent"), F.lit(True).alias("_gone"))
    begun = (withdrawn.select("slug", "_old_parent").join(first, "_old_parent", "left")
             .join(stops, "_old_parent", "left").join(gone, "_old_parent", "left"))
    kept = F.when(F.col("_gone"), none).when(
        F.col("_pos").isNotNull(), F.slice("_p", F.lit(1), F.col("_pos"))).otherwise(
        F.coalesce("_p", none))
    path = F.concat(F.array(parent), kept)
    open_end = F.coalesce("_gone", F.lit(False)) | F.col("_pos").isNotNull()
    start = begun.select(
        "slug", parent.alias("parent_slug"),
        F.when(parent.isNull(), none).otherwise(F.slice(path, 1, limit)).alias("path"),
        F.when(parent.isNull(), "root").when(open_end, F.lit(None))
        .when(F.col("_here").isNull(), "missing")
        .when(F.size(path) <= limit, F.col("_e")).alias("ended"))
    again = _doubled_paths(start, limit)
    restored = again.select("slug", "parent_slug", F.lit(False).alias("live"),
                            F.lit(False).alias("replaces"), F.col("parent_slug").alias("_old_parent"),
                            "path", "ended")
    tails = again.select(F.col("slug").alias("_at"), F.col("path").alias("_more"),
                         F.col("ended").alias("_then"))
    whole = F.concat(F.slice("path", F.lit(1), F.col("_pos")), "_more")
    moved = below.join(tails, "_at").select(
        "slug", "parent_slug", "live", "replaces", "_old_parent",
        F.slice(whole, 1, limit).alias("path"),
        F.when(F.size(whole) <= limit, F.col("_then")).alias("ended"))
    return moved.unionByName(restored)


def _unblocked(failing: DataFrame) -> DataFrame:
    """Failing records with no failing record above them (or on a cycle themselves).

    Their verdict is final; the others are judged again once these are gone.
    """
    below = failing.filter(~F.col("culprit").eqNullSafe(F.col("slug")))
    above = below.select("slug", F.explode("path").alias("_above"))
    marks = failing.select(F.col("slug").alias("_above"), F.lit(True).alias("_failing"))
    blocked = (lookup(above, marks, ["_above"], spread=["slug"])
               .filter("_failing").select("slug").distinct())
    return failing.join(blocked, "slug", "left_anti")


def children_of(tree: DataFrame) -> DataFrame:
    """Number of children per parent slug."""
    return (tree.filter(F.col("parent_slug").isNotNull()).groupBy("parent_slug")
            .agg(F.count(F.lit(1)).alias("children")))
