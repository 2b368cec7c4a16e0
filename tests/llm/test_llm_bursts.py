"""Prefix trie by bursts against a trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from sluice.llm import bursts
from sluice.llm.common import ready

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, box string"


def rebuilt(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda t: (*t[:2], t[2].encode(),
                                                                 t[3].encode()))]
           for c, t in by.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(totals[q][0] for q in below) or 1, own + sum(totals[q][1] for q in below))
    found = []
    for p, c in members.items():
        at = sorted(x for x in c if len(convs[x]) == len(p))
        found.append((min(c), len(p), min(members[p[:-1]]) if p else None, len(c),
                      len(kids.get(p, [])), *totals[p],
                      hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()))
    return sorted(found, key=repr)


def ours(spark, rows, **how):
    frame = ready(spark).createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = bursts.nodes(frame, **how)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                             "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(seed, n, longest, hot=0.3):
    rng = random.Random(seed)
    rows = []
    common = [("user", f"hot {i}") for i in range(longest)]
    for c in range(n):
        length = rng.randint(1, longest)
        same = rng.random() < hot
        for t in range(length):
            role, text = common[t] if same and rng.random() < .97 else (
                rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", "", None, "ccc")))
            rows.append((c if rng.random() < .99 else -c, rng.choice((t, t, t, None, 3)), role, text))
    rows += rng.sample(rows, 5) + [(None, 1, "user", "lost")] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"limit": 3}, {"limit": 2, "size": 4}, {"size": 3}])
def test_equals_plain_trie(spark, how):
    rows = made(11, 70, 14)
    assert ours(spark, rows, **how) == plain(rows)


def test_copies_and_growing_logs(spark):
    # Each conversation is a prefix of the next one, and a third are copies.
    rows = [(10 * c, t, "user", f"turn {t}") for c in range(1, 40) for t in range(c)]
    rows += [(1000 + 10 * c, t, "user", f"turn {t}") for c in range(20) for t in range(9)]
    assert ours(spark, rows, limit=4, size=8) == plain(rows)


def test_turnless_and_empty(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, 0, "user", "x")]) == []
    # Conversation 2 has h = 4, one turn and no base: nothing is left of it.
    lone = [(c, 0, "user", "x") for c in range(1, 5)]
    assert any(len(t) == 0 for t in rebuilt(lone).values())
    assert ours(spark, lone) == plain(lone)


def test_lists_of_ends_are_hashed_in_blocks(spark, monkeypatch):
    ready(spark)
    frame = spark.createDataFrame([("s", i) for i in range(-20, 10000)] + [("t", 5), ("t", 40)],
                                  "suffix string, conv bigint").repartition(5)
    found = {r["suffix"]: r["sha"] for r in bursts.ends(frame).collect()}
    assert found == {"s": hashlib.sha256(",".join(map(str, range(-20, 10000))).encode()).hexdigest(),
                     "t": hashlib.sha256(b"5,40").hexdigest()}
