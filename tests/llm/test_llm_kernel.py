"""Quality scores: held-out figures, sums against plain regression, odd rows."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import ready

FOLDER = "/root/testdata/sf0.01"
rng = random.Random(12)


def rank_share(scores, truth):
    """Chance that a good document scores above a bad one."""
    good = [s for s, t in zip(scores, truth) if t == 1]
    bad = [s for s, t in zip(scores, truth) if t == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_held_out_quality(spark):
    docs = ready(spark).read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    measured = kernel.measure(docs)
    found = kernel.scored(measured, kernel.fit(measured, labels))
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40
    assert rank_share([r["score"] for r in rows], [r["quality"] for r in rows]) >= 0.95
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def prose(n):
    return ". ".join(" ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8)))
                              for _ in range(9)).capitalize() for _ in range(n)) + "."


def small(spark, swap=False):
    rows = [(i, prose(8) if i % 3 else prose(8).upper().replace(" ", "!! ")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x"), (None, prose(5)), (7, rows[7][1])]
    rows += [(7, rows[7][1])] * 100 + [(1004, "long words " * 300_000), (1005, "ж" * 50)]
    docs = ready(spark).createDataFrame(
        [(i, t, "en", 0.5, 1) for i, t in rows],
        "doc_id bigint, text string, lang string, score double, quality int")
    marks = [(i, int(bool(i % 3)) ^ swap, 0) for i in range(300)] + [
        (None, 1, 0), (7, 1, 0), (8, None, 0), (9, 5, 0), (99999, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_odd_rows_and_rows_not_learned_from(spark):
    docs, labels = small(spark)
    measured = kernel.measure(docs)
    model = kernel.fit(measured, labels)
    rows = kernel.scored(measured, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    right = [(r["score"] > 0.5) == bool(r["doc_id"] % 3) for r in rows
             if r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(right) / len(right) > 0.97
    # Labels of held-out documents change nothing.
    flipped = labels.withColumn("quality", F.when(kernel.held_out(F.col("doc_id")),
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    again = kernel.fit(measured, flipped)
    assert np.array_equal(again.weights, model.weights)
    assert np.array_equal(again.curve, model.curve)


def test_no_labels_and_no_documents(spark):
    docs, labels = small(spark)
    measured = kernel.measure(docs)
    scores = kernel.scored(measured, kernel.fit(measured, labels.limit(0))).collect()
    assert {r["score"] for r in scores} == {0.5}
    none = kernel.measure(docs.limit(0))
    assert kernel.scored(none, kernel.fit(none, labels)).count() == 0
    one_kind = kernel.fit(measured, labels.filter("quality = 1"))
    assert {r["predicted"] for r in kernel.scored(measured, one_kind).collect()} == {1}


def test_summed_equations_give_the_plain_regression(spark):
    docs, labels = small(spark)
    measured = kernel.measure(docs).repartition(7)
    model = kernel.empty_model(measured)
    rows = kernel.labelled(measured, labels)
    sums = sum(kernel.normal_equations(rows, model).values())
    local = rows.collect()
    z = model.features(np.array([r["x"] for r in local]))
    y = np.array([r["y"] for r in local])
    n = len(local)
    ridge = np.full(z.shape[1], 1e-3 * n)
    ridge[-1] = 1e-9
    plain = np.linalg.lstsq(np.vstack((z, np.diag(np.sqrt(ridge)))),
                            np.concatenate((y, np.zeros(z.shape[1]))), rcond=None)[0]
    assert np.allclose(z @ kernel.solve(sums, 1e-3), z @ plain, atol=1e-5)
    assert np.isclose(kernel.squared_error(sums, plain), ((z @ plain - y) ** 2).sum(), atol=1e-6)


def test_features_approximate_the_kernel():
    n = len(kernel.NAMES)
    gen = np.random.default_rng(1)
    model = kernel.Model(np.zeros(n), np.ones(n), gen.normal(0, 1 / n ** 0.5, (n, 20000)),
                         gen.uniform(0, 2 * np.pi, 20000))
    x = gen.normal(0, 1, (20, n))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * n))
    assert np.abs(z @ z.T - exact).max() < 0.06


def test_isotonic_is_the_best_monotone_curve():
    gen = np.random.default_rng(3)
    for _ in range(50):
        y, w = gen.random(6), gen.integers(1, 5, 6).astype(float)
        at, curve = kernel.isotonic(np.arange(6.0), y, w)
        assert (np.diff(curve) >= 0).all() and (np.diff(at) > 0).all()
        # Max-min formula of isotonic regression.
        best = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(i, 6))
                    for a in range(i + 1)) for i in range(6)]
        assert np.isclose(sorted(set(np.round(best, 9))), sorted(set(np.round(curve, 9)))).all()


def test_pieces_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(kernel, "PIECE", 50)
    for text in ("", "x" * 175, prose(20), "ab\n" * 60):
        parts = list(kernel.pieces(text))
        assert "".join(parts) == text and all(0 < len(p) <= 50 for p in parts)
    long = prose(40)
    in_pieces = kernel.statistics(long)
    monkeypatch.setattr(kernel, "PIECE", 1 << 20)
    whole = kernel.statistics(long)
    assert np.isclose(in_pieces[0], whole[0]) and np.isclose(in_pieces[2], whole[2])
