"""Clustering by approximations against a plain search over all centroids."""

import hashlib
import random

import numpy as np

from sluice.llm import vafile
from sluice.llm.common import ready

rng = random.Random(13)
SCHEMA = "vec_id bigint, embedding array<float>, cluster int, distance string"


def plain(rows, dims, k, rounds, seed=2):
    """Python integers, no approximations."""
    good = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims
            and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v)
                   for i, v in good)[:k]
    centroids = [v for _, v in first]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v in good]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(good, at) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *assign(v)) for i, v in good]
    return sorted(((i, c, min(d, vafile.LONGEST), hashlib.sha256(
        ",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def clustered(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    found = vafile.cluster(frame, **how).collect()
    per, total = {}, 0
    for r in found:
        per[r["cluster"]] = per.get(r["cluster"], 0) + r["distance"]
        total += r["distance"]
    for r in found:
        assert r["cluster_inertia"] == min(per[r["cluster"]], vafile.LONGEST)
        assert r["inertia"] == min(total, vafile.LONGEST)
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"])
                   for r in found), key=repr)


def test_equals_plain_search(spark):
    ready(spark)
    middles = [[rng.gauss(0, .2) for _ in range(8)] for _ in range(6)]
    rows = [(n, [m + rng.gauss(0, .05) for m in middles[n % 6]]) for n in range(400)]
    rows += [(n, [rng.gauss(0, .1) for _ in range(8)]) for n in range(400, 700)]
    # A third are copies, some share an id, some have none.
    rows += [(n, rows[5][1]) for n in range(700, 1000)] + [(5, rows[9][1]), (None, rows[3][1])] * 2
    how = {"dims": 8, "k": 12, "rounds": 4}
    assert clustered(spark, rows, **how) == plain(rows, 8, 12, 4)


def test_faulty_vectors_are_left_out_and_extremes_stay(spark):
    ready(spark)
    rows = [(0, None), (1, []), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 0.0]),
            (5, [float("inf"), 0.0]), (6, [0.5, 0.25]), (7, [-0.001, 0.0]), (8, [0.0, -0.0]),
            (9, [3e38, -3e38]), (10, [1e30, 1.0]), (11, [0.5, 0.25]), (12, [2e6, 2e6])]
    for k in (3, 40):
        assert clustered(spark, rows, dims=2, k=k, rounds=2) == plain(rows, 2, k, 2)
    assert clustered(spark, rows[:6], dims=2) == []
    assert clustered(spark, [], dims=2) == []


def test_intervals_hold_the_distances_and_decide_most():
    x = np.array([[rng.gauss(0, 32) for _ in range(16)] for _ in range(2000)]).round()
    whole = x.astype(np.int64)
    cells = vafile.Cells(x.min(0), x.max(0), x.mean(0), x.std(0))
    codes = cells.encode(whole)
    assert codes.max() < 1 << vafile.CELL_BITS
    every = np.arange(16)
    assert (np.abs(whole - cells.middle[every, codes]) <= cells.half[every, codes]).all()
    search = vafile.Search(cells, [list(map(int, v)) for v in whole[:10]])
    low, high = search.intervals(codes)
    reference = search.centroids.astype(float).mean(axis=0)
    base = ((whole - reference) ** 2).sum(axis=1)[:, None]
    exact = ((whole[:, None] - search.centroids[None]) ** 2).sum(axis=2) - base
    assert (low <= exact).all() and (exact <= high).all()
    chosen, fetched = search.nearest(codes, whole.__getitem__)
    assert (chosen == exact.argmin(axis=1)).all()
    assert fetched < 1000


def test_equal_distances_take_the_smaller_centroid():
    whole = np.array([[0, 0], [2, 0], [1, 0]])
    x = whole.astype(float)
    cells = vafile.Cells(x.min(0), x.max(0), x.mean(0), x.std(0))
    for order in ([[0, 0], [2, 0]], [[2, 0], [0, 0]], [[2, 0], [2, 0]]):
        chosen, _ = vafile.Search(cells, order).nearest(cells.encode(whole), whole.__getitem__)
        assert chosen[2] == 0
