"""Decontamination against plain search, with one block of windows and with many."""

import random
import re

from pyspark.sql import functions as F

from sluice.llm import decontam
from sluice.llm.common import ready

TOKEN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = random.Random(3)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TOKEN.findall(low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i:i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    found |= {str(o) for o in owners if o is not None}
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def sentence(n):
    return " ".join(rng.choice(("alpha", "Beta", "größe", "x1", "the", "of")) for _ in range(n))


ITEMS = [(1, sentence(40)), (2, sentence(13)), (10, "Short ITEM, here"), (None, sentence(20)),
         (4, None), (5, "..."), (6, sentence(12)), (2, sentence(15))]
DOCS = [sentence(60), "x " * 9 + ITEMS[0][1] + " y" * 30, "a short item here, b", None, "", "!!",
        "It's " + ITEMS[3][1].upper() + "; " + ITEMS[1][1], sentence(5000) + ITEMS[6][1],
        " ".join([ITEMS[0][1]] * 3), "short item", "z" * 100_000]


def tables(spark):
    ready(spark)
    docs = spark.createDataFrame([(i, t, "h", 3) for i, t in enumerate(DOCS)] + [(None, DOCS[1], "h", 3)] * 2,
                                 "doc_id bigint, text string, hits string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_hits_match_plain_search(spark):
    docs, items = tables(spark)
    want = brute(DOCS, ITEMS)
    for limits in ({}, {"block_windows": 9}, {"block_bytes": 700}):
        # Columns of the block path's own names.
        clash = docs.withColumns({c: F.lit(1) for c in ("_id", "_hash", "_hit", "_items", "_hits")})
        found, name = decontam.find_hits(clash, items, **limits)
        assert set(found.columns) == {*clash.columns, name}
        got = {r["doc_id"]: (r["n_words"], r["hit"], r["items"])
               for r in found.select("doc_id", F.col(name + ".*")).collect()}
        assert [got[i] for i in range(len(DOCS))] == want
        assert got[None] == want[1]


def test_removal(spark):
    docs, items = tables(spark)
    bad = {i for i, (n, hit, _) in enumerate(brute(DOCS, ITEMS)) if hit and 20 * len(hit) >= n}
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(DOCS))) - bad
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, items).collect()}
    assert cut[2] == "a , b" and cut[0] == DOCS[0] and cut[3] is None and cut[9] == DOCS[9]
    assert words(cut[1]) == ["x"] * 9 + ["y"] * 30
    assert decontam.remove_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontam.remove_contaminated(docs.limit(0), items).count() == 0
