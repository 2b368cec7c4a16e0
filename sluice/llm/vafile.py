"""Centroid clustering over a vector-approximation file.

Every vector is kept beside its approximation: one cell number of CELL_BITS bits per
dimension, the cells of a dimension being fixed once from figures over all vectors.  Two
lookup tables give a cell's middle and half width; from them follows, per centroid, an
interval that holds

    d(v, c) - d(v, r)  =  |c - r|^2 - 2 (c - r)(v - r)

where r is a common reference point, so the unknown part of a vector counts only as far as
centroids differ.  A centroid stays in the running if its interval begins below the lowest
end of all intervals.  One left decides the vector; otherwise the full vector is fetched and
its exact integer distances to the centroids left are compared.  Assignments are those of a
full search, ties included.

A round is one scan: tasks add up their vectors per centroid, and the driver sees one sum
per centroid and dimension.  The new centroids need every vector's components, so a round
reads both columns; the approximations save the distances, not the reading.

Rows kept: vectors with exactly ``dims`` components, none NULL or not finite.  Others are
left out, a NULL ``vec_id`` is not.  Repeated rows count each.  With fewer vectors than
``k`` every vector starts a centroid; no vectors give no rows.  Of equal hashes the smaller
vector comes first.  Distances and sums beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut

CELL_BITS = 6
# The inner cells of a dimension lie within so many deviations of its mean.
REACH = 3.0
LONGEST = (1 << 63) - 1
# Components up to this size have exact distances in 64-bit integers.
PLAIN = 1 << 27
# Sums may outgrow a decimal of 38 digits: they travel as text in two parts, at this bit.
SPLIT = 80


def kept(vectors: DataFrame, ident: str, vector: str, dims: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors with ``dims`` finite components."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce((F.size(v) == dims) & sound, F.lit(False))).select(
        F.col(ident).alias("vec_id"), v.alias("v"))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of a column of vectors, as 64-bit or, where too large, Python integers."""
    x = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    x = x.reshape(-1, dims)
    if x.size and np.abs(x).max() > PLAIN:
        whole = np.empty(x.shape, dtype=object)
        whole[...] = [[int(c) for c in row] for row in x]
        return whole
    return x.astype(np.int64)


class Cells:
    """Cell borders of each dimension, and the middle and half width of every cell."""

    def __init__(self, low, high, mean, deviation, bits: int = CELL_BITS) -> None:
        n = 1 << bits
        self.borders, middle, half = [], [], []
        for lo, hi, m, s in zip(low, high, mean, deviation):
            steps = np.ceil(np.linspace(max(lo, m - REACH * s), min(hi, m + REACH * s), n - 1))
            self.borders.append(steps)
            # Cell i holds the integers border[i-1] <= x < border[i]; the outer ones
            # reach the extremes.  Very large ends are rounded: the last term covers that.
            first = np.concatenate(([min(lo, steps[0])], steps))
            last = np.maximum(first, np.concatenate((steps - 1, [max(hi, steps[-1])])))
            middle.append((first + last) / 2)
            half.append((last - first) / 2 + (np.abs(first) + np.abs(last)) * 2.0 ** -50)
        self.middle, self.half = np.array(middle), np.array(half)

    def encode(self, whole: np.ndarray) -> np.ndarray:
        x = whole.astype(np.float64)
        return np.stack([np.searchsorted(b, x[:, d], side="right")
                         for d, b in enumerate(self.borders)], axis=1).astype(np.uint8)


class Search:
    """Nearest centroids of a batch by intervals first, exact distances where these overlap."""

    def __init__(self, cells: Cells, centroids: list[list[int]]) -> None:
        self.cells = cells
        large = max((abs(x) for c in centroids for x in c), default=0) > PLAIN
        self.centroids = np.array(centroids, dtype=object if large else np.int64)
        c = self.centroids.astype(np.float64)
        reference = c.mean(axis=0)
        self.turn = c - reference
        self.constant = (self.turn ** 2).sum(axis=1) + 2 * (self.turn @ reference)

    def intervals(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends per vector and centroid."""
        every = np.arange(codes.shape[1])
        middle, half = self.cells.middle[every, codes], self.cells.half[every, codes]
        centre = self.constant - 2 * (middle @ self.turn.T)
        # What rounding of these sums may come to, with room to spare.
        slack = 2.0 ** -40 * (np.abs(self.constant) + 2 * (np.abs(middle) @ np.abs(self.turn).T))
        width = 2 * (half @ np.abs(self.turn).T) + slack
        return centre - width, centre + width

    def nearest(self, codes: np.ndarray, fetch) -> tuple[np.ndarray, int]:
        """Centroid per row, and how many rows ``fetch(rows)`` had to give in full."""
        low, high = self.intervals(codes)
        running = low <= high.min(axis=1)[:, None]
        chosen = running.argmax(axis=1)
        open_rows = np.flatnonzero(running.sum(axis=1) > 1)
        if len(open_rows):
            row, centroid = np.nonzero(running[open_rows])
            full = fetch(open_rows)
            best: list = [None] * len(open_rows)
            distance = self.distances(full[row], centroid)
            # By row, distance, centroid: the first of each row is its nearest.
            order = np.lexsort((centroid, distance, row)) if distance.dtype != object else sorted(
                range(len(row)), key=lambda i: (row[i], distance[i], centroid[i]))
            for i in reversed(order):
                best[row[i]] = centroid[i]
            chosen[open_rows] = best
        return chosen, len(open_rows)

    def distances(self, full: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to the centroid named beside it."""
        gap = full - self.centroids[centroid]
        return (gap * gap).sum(axis=1)


def build(rows: DataFrame, dims: int) -> tuple[DataFrame, Cells]:
    """The approximation file: ``(vec_id, v, cells)``, and its lookup tables."""
    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second, low, high = 0, 0.0, 0.0, np.inf, -np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column("v"), dims).astype(np.float64)
            n += len(x)
            first, second = first + x.sum(axis=0), second + (x * x).sum(axis=0)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()),
                "s": first, "q": second, "low": low, "high": high})

    parts = rows.select("v").mapInArrow(
        figures, "d int, n bigint, s double, q double, low double, high double")
    total = sorted(parts.groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.min("low").alias("low"), F.max("high").alias("high")).collect())
    mean = [r["s"] / r["n"] for r in total]
    deviation = [max(r["q"] / r["n"] - m * m, 0.0) ** 0.5 for r, m in zip(total, mean)]
    cells = Cells([r["low"] for r in total], [r["high"] for r in total], mean, deviation)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cells.encode(integers(batch.column("v"), dims)) if batch.num_rows else []
            yield batch.append_column("cells", pa.array([c.tobytes() for c in codes],
                                                        pa.binary()))

    schema = rows.select("vec_id", "v").schema.add("cells", "binary")
    return cut(rows.select("vec_id", "v").mapInArrow(encode, schema), "cells"), cells


def _codes(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    joined = b"".join(batch.column("cells").to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, dims)


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of smallest hash, in the order of their hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    picked = (rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "v")
              .orderBy("h", "v").limit(k).collect())
    return [[int(np.floor(256.0 * x)) for x in r["v"]] for r in picked]


def one_round(file: DataFrame, search: Search, dims: int) -> list[list[int]]:
    """The centroids after one assignment of all vectors."""
    k = len(search.centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch.column("v"), dims)
            chosen, _ = search.nearest(_codes(batch, dims), whole.__getitem__)
            for c in np.unique(chosen):
                mine = whole[chosen == c]
                counts[c] += len(mine)
                total = [int(x) for x in mine.sum(axis=0)]
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * dims), total)]
        yield pa.RecordBatch.from_pydict({
            "c": pa.array([c for c in sums for _ in range(dims)], pa.int32()),
            "d": pa.array([d for _ in sums for d in range(dims)], pa.int32()),
            "n": pa.array([counts[c] for c in sums for _ in range(dims)], pa.int64()),
            "high": pa.array([str(x >> SPLIT) for c in sums for x in sums[c]], pa.string()),
            "low": pa.array([str(x % (1 << SPLIT)) for c in sums for x in sums[c]],
                            pa.string())})

    parts = file.select("v", "cells").mapInArrow(
        add_up, "c int, d int, n bigint, high string, low string")
    total = parts.groupBy("c", "d").agg(F.sum("n").alias("n"), *[
        F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("high", "low")]).collect()
    after = [list(map(int, c)) for c in search.centroids]
    for r in total:
        after[r["c"]][r["d"]] = ((int(r["high"]) << SPLIT) + int(r["low"])) // r["n"]
    return after


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding",
            dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """``(vec_id, cluster, distance)`` of the kept vectors with their cluster's figures."""
    rows = kept(vectors, ident, vector, dims)
    schema = rows.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    centroids = first_centroids(rows, k, seed)
    if centroids:
        file, cells = build(rows, dims)
        for _ in range(rounds):
            centroids = one_round(file, Search(cells, centroids), dims)
        search = Search(cells, centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                whole = integers(batch.column("v"), dims)
                chosen, _ = search.nearest(_codes(batch, dims), whole.__getitem__)
                distance = [min(int(x), LONGEST) for x in search.distances(whole, chosen)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(chosen, pa.int32()),
                     pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

        found = cut(file.select("vec_id", "v", "cells").mapInArrow(assign, schema), "assigned")
    else:
        found = vectors.sparkSession.createDataFrame([], schema)
    hashes = vectors.sparkSession.createDataFrame(
        [(i, centroid_hash(c)) for i, c in enumerate(centroids)],
        "cluster int, centroid_sha256 string")
    exact = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(exact).alias("s"))

    def as_long(sum_of: Column) -> Column:
        return F.least(sum_of, F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")

    # One row per centroid: at most k rows are broadcast.
    total = found.agg(F.sum(exact).alias("t")).scalar()
    figures = sums.join(F.broadcast(hashes), "cluster").select(
        "cluster", as_long(F.col("s")).alias("cluster_inertia"),
        as_long(total).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
