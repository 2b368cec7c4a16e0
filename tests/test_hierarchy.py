"""Category trees against a step-by-step walk."""

import random

import pytest

from sluice.operators import hierarchy

SCHEMA = "slug string, parent_slug string"


def walk(tree, slug):
    seen, cur, depth = {slug}, tree[slug], 0
    if cur is None:
        return "ok", None, 0
    while True:
        if cur in seen:
            return "cycle", cur, None
        if depth > hierarchy.MAX_DEPTH:
            return "too_deep", None, None
        seen.add(cur)
        if cur not in tree:
            return "missing", cur, None
        depth += 1
        if tree[cur] is None:
            return "ok", None, depth
        cur = tree[cur]


def verdicts(frame):
    return {r.slug: (r.outcome, r.culprit, r.depth) for r in frame.collect()}


def test_random_forests(spark):
    rng = random.Random(5)
    tree = {}
    for i in range(600):
        kind = rng.random()
        tree[f"n{i}"] = (None if kind < 0.05 else f"n{rng.randint(0, 599)}" if kind < 0.3
                         else f"n{max(i - rng.randint(1, 3), 0)}" if kind < 0.97 else f"gone{i}")
    tree["n0"] = None
    got = verdicts(hierarchy.parent_chain_check(spark.createDataFrame(list(tree.items()), SCHEMA)))
    assert got == {s: walk(tree, s) for s in tree}


def test_depth_limit_and_long_cycles(spark):
    chain = {f"c{i}": f"c{i - 1}" if i else None for i in range(80)}
    open_end = {f"o{i}": f"o{i - 1}" if i else "gone" for i in range(80)}
    cycle = {f"r{i}": f"r{(i + 1) % 66}" for i in range(66)} | {
        f"b{i}": f"b{(i + 1) % 67}" for i in range(67)}
    tail = {"t0": "r5", "t1": "t0", "u0": "s0", "s0": "s1", "s1": "s0"}
    tree = chain | open_end | cycle | tail
    got = verdicts(hierarchy.parent_chain_check(spark.createDataFrame(list(tree.items()), SCHEMA)))
    assert got == {s: walk(tree, s) for s in tree}
    assert got["c65"] == ("ok", None, 65) and got["c66"][0] == "too_deep"
    assert got["r0"] == ("cycle", "r0", None) and got["b0"][0] == "too_deep"


def test_depth_is_a_parameter(spark):
    tree = {"r": None} | {f"d{i}": f"d{i - 1}" if i else "r" for i in range(8)}
    frame = spark.createDataFrame(list(tree.items()), SCHEMA)
    got = verdicts(hierarchy.parent_chain_check(frame, max_depth=3))
    assert got["d3"] == ("ok", None, 4) and got["d4"][0] == "too_deep"


def test_many_rows_share_an_ancestor(spark):
    tree = {"root": None, "hot": "root", "deep": "hot"} | {
        f"x{i}": rng for i, rng in enumerate(["hot", "deep", "gone"] * 100)} | {
        f"y{i}": f"x{i}" for i in range(300)}
    got = verdicts(hierarchy.parent_chain_check(spark.createDataFrame(list(tree.items()), SCHEMA)))
    assert got == {s: walk(tree, s) for s in tree}


@pytest.mark.parametrize("stored, accepted, expected", [
    # Order of rows does not matter, children may come first.
    ({}, {"gaming-laptops": "laptops", "laptops": "electronics", "electronics": None},
     {"gaming-laptops": "ok", "laptops": "ok", "electronics": "ok"}),
    ({"a": None}, {"b": "a", "c": "ghost", "d": "c"}, {"b": "ok", "c": "missing", "d": "missing"}),
    ({}, {"a": "b", "b": "a", "c": "a"}, {"a": "cycle", "b": "cycle", "c": "cycle"}),
    # A stored child may not become its parent's parent.
    ({"a": None, "b": "a"}, {"a": "b"}, {"a": "cycle"}),
    # A replacement that cannot land leaves the stored record to its children.
    ({"p": None}, {"p": "ghost", "c": "p"}, {"p": "missing", "c": "ok"}),
    ({"q": None, "r": None}, {"q": "ghost", "r": "q", "c": "r"},
     {"q": "missing", "r": "ok", "c": "ok"}),
    # A replacement that lands repairs what hangs below it.
    ({"p": "gone"}, {"p": None, "c": "p"}, {"p": "ok", "c": "ok"}),
])
def test_resolve(spark, stored, accepted, expected):
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    got = verdicts(hierarchy.hierarchy_resolve(frame(stored), frame(accepted)))
    assert {s: v[0] for s, v in got.items()} == expected


def resolved(stored, accepted):
    """Withdraw failing replacements whose failing ancestors are none (or themselves), again
    and again, by walking."""
    live, verdict = dict(accepted), {}
    while True:
        tree = {**stored, **live}
        now = {s: walk(tree, s) for s in live}
        failing = {s for s in live if now[s][0] != "ok" and s in stored}
        if not failing:
            return {**verdict, **now}

        def blocked(s):
            if now[s][1] == s:
                return False
            cur, seen = tree[s], []
            while cur is not None and len(seen) < hierarchy.MAX_DEPTH + 2:
                seen.append(cur)
                cur = tree.get(cur)
            return any(x in failing for x in seen)

        gone = {s for s in failing if not blocked(s)}
        assert gone
        verdict |= {s: now[s] for s in gone}
        for s in gone:
            del live[s]


@pytest.mark.parametrize("seed", range(4))
def test_resolve_random_replacements(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(120)]

    def parent(i):
        kind = rng.random()
        return (None if kind < 0.1 else "ghost" if kind < 0.17 else rng.choice(names)
                if kind < 0.35 else names[max(0, i - rng.randint(1, 4))])

    stored = {n: parent(i) for i, n in enumerate(names) if rng.random() < 0.7}
    accepted = {n: parent(i) for i, n in enumerate(names) if rng.random() < 0.5}
    for tree in (stored, accepted):
        for n in [n for n, p in tree.items() if p == n]:
            tree[n] = None
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    got = verdicts(hierarchy.hierarchy_resolve(frame(stored), frame(accepted)))
    assert got == resolved(stored, accepted)


def test_children_and_messages(spark):
    from pyspark.sql import functions as F
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "x")], SCHEMA)
    assert {r.parent_slug: r.children for r in hierarchy.children_of(tree).collect()} == {
        "a": 2, "x": 1}
    text = hierarchy.parent_chain_check(tree).filter("slug = 'd'").select(
        hierarchy.outcome_message(F.col("outcome"), F.col("culprit")).alias("m")).first().m
    assert text == ("parent category 'x' does not exist -- import it first, "
                    "then re-import this record")
