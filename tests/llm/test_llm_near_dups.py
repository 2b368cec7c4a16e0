"""Near-duplicates against all pairs; the signature against full simulation."""

import random

import numpy as np

from sluice.llm import near_dups, shingles
from sluice.llm.common import ready

rng = random.Random(17)


def prose(n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(words, share):
    return [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus():
    docs, base = [], [prose(rng.randint(30, 300)) for _ in range(25)]
    for i in range(120):
        docs.append((i, " ".join(changed(rng.choice(base), rng.choice((0, 0.005, 0.02, 0.2))))))
    near = prose(200)  # one large group, every member a text of its own
    docs += [(1000 + i, " ".join(changed(near, 0.012))) for i in range(60)]
    docs += [(2000 + i, " ".join(prose(50))) for i in range(40)]
    return docs + [(3000, None), (3001, ""), (3002, "?!"), (3003, "One, two."), (3004, "one two"),
                   (3005, "one"), (None, "one two"), (3006, "same row here"), (3006, "same row here"),
                   (3007, " ".join(prose(60_000)))]


def shingle_set(text):
    words = shingles.word_hashes(text)
    return set(shingles.shingle_hashes(words).tolist())


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(docs[i][0])
    return [min((d for d in members[find(i)] if d is not None), default=None)
            for i in range(len(docs))]


def test_classes_match_all_pairs(spark):
    ready(spark)
    docs = corpus()
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id bigint, text string, key string")
    found, name = near_dups.annotate(frame)
    rows = found.collect()
    got = {(r["doc_id"], r["text"]): r[name]["class_id"] for r in rows}
    assert len(rows) == len(docs)
    assert [got[d] for d in docs] == brute(docs)
    kept = near_dups.keep_first(frame)
    assert kept.columns == frame.columns
    classes = [c for c, (_, t) in zip(brute(docs), docs, strict=True) if shingle_set(t)]
    assert kept.count() == len(set(classes)) + 3
    assert near_dups.keep_first(frame.limit(0)).count() == 0


def full_signature(elements, weights, size, points):
    """Every arrival simulated, none left out early."""
    first, kept = [float("inf")] * size, [0] * size
    for e, w in zip(elements, weights, strict=True):
        t = 0.0
        for k in range(1, points):
            seed = shingles.mix(np.array([e], np.uint64)
                                + np.array([k], np.uint64) * np.uint64(0xA0761D6478BD642F))
            t += float(-np.log1p(-((seed >> np.uint64(11)) * 2.0 ** -53))[0] / w)
            at = int(shingles.mix(seed)[0] % np.uint64(size))
            if t < first[at]:
                first[at], kept[at] = t, int(e)
    return kept


def test_early_termination_changes_nothing():
    for n in (1, 3, 40):
        elements = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        weights = np.array([1 + rng.random() for _ in range(n)])
        got = near_dups.signature(elements, weights, 16)
        assert got.tolist() == full_signature(elements, weights, 16, 400)


def test_signatures_estimate_similarity():
    words = [f"v{i}" for i in range(2000)]
    a = np.unique(shingles.shingle_hashes(shingles.word_hashes(" ".join(words))))
    b = np.unique(shingles.shingle_hashes(shingles.word_hashes(" ".join(words[250:]))))
    one = np.ones
    agree = (near_dups.signature(a, one(len(a)), 2048)
             == near_dups.signature(b, one(len(b)), 2048)).mean()
    assert abs(agree - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.04


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(prose(3000)) + " é" * 10
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "BLOCK", 101)
    assert (shingles.word_hashes(text) == whole).all() and len(whole) == 3010
