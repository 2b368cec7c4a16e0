"""Substring dedup on sliding sentence spans.

A text is a list of sentences: pieces that end with ``.``, ``!`` or ``?`` or at a line's
end and hold a word.  At every sentence starts one span and ends one, the shortest run of
at least ``SENTENCES`` sentences with at least ``WORDS`` words, so equal passages give
equal spans wherever they stand, and spans reach to both ends of a passage.  Spans are hashed (128 bits over the normalised words,
sentence by sentence) and joined over the whole corpus; sentences that any but the
first occurrence of a repeated span covers are removed.  First means the smallest
doc_id (NULL last), then hash of the text, then position.

Scale: hashes are counted with partial aggregation, so a passage in a third of all
documents costs one row per task; only hashes found twice or more are joined back, on a
plain key that adaptive execution can split.  Texts are not part of that join; removed
sentences (numbers only) are gathered per document, which its length bounds.

Defined cases: NULL texts have no sentences and stay NULL; texts with fewer words than a
span have no spans; repeated rows (same doc_id and text) are one document and lose the
same sentences, so a row's copy does not count as a repetition; an empty table stays
empty; further columns pass through, under any name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, unused
from sluice.llm.decontam import normal_words

SENTENCES = 2
WORDS = 20
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]++|\n|\Z)")


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the sentences that hold a word."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        words = normal_words(m.group())
        if words:
            out.append((m.start(), m.end(), words))
    return out


def runs(text: str | None, least: int = SENTENCES, words: int = WORDS) -> list[tuple]:
    """(high, low, first, last): hash of each span and its sentences."""
    found = sentences(text)
    n = len(found)
    digests = [xxhash.xxh3_128_digest(b" ".join(s[2])) for s in found]
    sizes = np.cumsum([0, *(len(s[2]) for s in found)])
    # The first end with enough words after each start, the last start before each end.
    lasts = np.maximum(np.searchsorted(sizes, sizes[:-1] + words) - 1, np.arange(n) + least - 1)
    firsts = np.minimum(np.searchsorted(sizes, sizes[1:] - words, "right") - 1,
                        np.arange(n) - least + 1)
    places = {(i, j) for i, j in enumerate(lasts.tolist()) if j < n}
    places |= {(i, j) for j, i in enumerate(firsts.tolist()) if i >= 0}
    out = []
    for i, j in sorted(places):
        pair = np.frombuffer(xxhash.xxh3_128_digest(b"".join(digests[i:j + 1])), np.int64)
        out.append((int(pair[0]), int(pair[1]), i, j))
    return out


def span_rows(docs: DataFrame) -> DataFrame:
    """doc, h (hash of the text), high, low, first, last: one row per span."""
    def spread(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("high", "low", "first", "last"), r, strict=True))
                           for r in runs(t)] for t in texts], dtype=object)
    kind = "array<struct<high:bigint,low:bigint,first:int,last:int>>"
    return (docs.filter(F.col("text").isNotNull())
            .select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"),
                    F.pandas_udf(spread, kind)("text").alias("s"))
            .select("doc", "h", F.explode("s").alias("s")).select("doc", "h", "s.*"))


def repeated(docs: DataFrame) -> DataFrame:
    """One row per document with sentences to remove: doc, h, gone (their numbers)."""
    spans = cut(span_rows(docs), "spans")
    key = ["high", "low"]
    # Cut, so that the join deals out both sides anew and can split a hot span.
    twice = cut(spans.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
                .filter("n > 1").drop("n"), "twice")
    found = cut(spans.join(twice, key), "repeated")
    # Where a span first occurs: within the smallest doc_id, by text and position.
    own = found.filter(F.col("doc").eqNullSafe(F.col("least")))
    place = F.struct("h", "first")
    start = cut(own.groupBy(*key).agg(F.min(place).alias("start")), "starts")
    late = found.join(start, key).filter(
        ~F.col("doc").eqNullSafe(F.col("least")) | (place != F.col("start")))
    covered = late.select("doc", "h", F.explode(F.sequence("first", "last")).alias("at"))
    return covered.groupBy("doc", "h").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def _strip(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, numbers in zip(texts, gone, strict=True):
        if text is None or not len(numbers):
            out.append(text)
            continue
        drop, kept, at = set(map(int, numbers)), [], 0
        for i, (start, end, _) in enumerate(sentences(text)):
            if i in drop:
                kept.append(text[at:start])
                at = end
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out, dtype=object)


def annotate(docs: DataFrame, rows: DataFrame | None = None,
             text_hash: Column | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: numbers of the sentences to remove.

    ``rows`` may be a narrower form of ``docs`` with doc_id, and ``text_hash`` its column
    with the hash of the text.
    """
    rows = docs if rows is None else rows
    name, doc, h = (unused(rows, n) for n in ("removed_sentences", "_span_doc", "_span_h"))
    gone = repeated(docs).select(F.col("doc").alias(doc), F.col("h").alias(h),
                                 F.col("gone").alias(name))
    text_hash = F.xxhash64("text") if text_hash is None else text_hash
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_hash == F.col(h))
    joined = rows.join(gone, same, "left").drop(doc, h)
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<int>"))), name


def remove_spans(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed sentences; ``n_chars`` is left as it is."""
    found, name = annotate(docs)
    return found.withColumn("text", F.pandas_udf(_strip, "string")("text", name)).drop(name)
