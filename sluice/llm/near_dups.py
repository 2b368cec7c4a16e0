"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is its set of five-word shingles; a shingle found c times weighs
1 + log2(c) / 4.  Every shingle sends arrivals of a Poisson process of its weight's rate
to random components of the signature; a component keeps the shingle of its earliest
arrival.  Shingles stop as soon as their next arrival comes after the latest one kept,
so after the first few most stop at once.  Two documents agree in a component with
their probability Jaccard, the weighted form of Jaccard's.  ``BANDS`` bands of ``ROWS``
components make buckets; pairs are verified on the whole shingle sets: documents are
linked at a Jaccard similarity of ``THRESHOLD`` or more.  At 0.8 a pair shares no
bucket with probability (1 - 0.8**4)**20 = 0.00003.

Copies (equal words in equal order) are one text, found by one aggregate, and only
texts enter the buckets.  Groups of near copies may hold thousands of texts:

1. star: each text is held against the most central text of its buckets, the one that
   shares its buckets with the most texts (in a group, what the others are copies of);
2. star again, against a random text of each bucket, for texts still in different classes;
3. all pairs of a bucket that are still in different classes and can be similar: what a
   text has in common with another is at most its shingles that any other text here has,
   and parity bits of their sets bound how much two texts differ.  Both bounds are exact.

Links join classes after each step, so step 3 meets few pairs, and loses none.  Classes
are connected components by minimum labels with pointer jumping; labels and links
stay distributed, each round is cut to the shared folder.

Verification fetches shingle sets of candidates only, picked from the documents by a
bitmap of fixed size.  Joins are on plain keys, which adaptive execution can split.

Defined cases: documents without words (NULL, empty, punctuation) are their own
class; texts of fewer than five words are one shingle; repeated rows (same doc_id and
text) are one document to the classes, and ``keep_first`` keeps one row of them; NULL
doc_id sorts last; an empty table stays empty; further columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import shingles
from sluice.llm.common import bitmap, cut, in_bitmap, unused

THRESHOLD = 0.8
BANDS, ROWS = 20, 4
PARITY = 512
_UNIT = 2.0 ** -53
_STEP = np.uint64(0xA0761D6478BD642F)


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The element that arrives first at each of ``size`` components."""
    kept = np.zeros(size, np.uint64)
    first = np.full(size, np.inf)
    drawn = np.zeros(len(elements), np.uint64)
    clock = np.zeros(len(elements))
    heaviest = weights.max()
    limit = size * (math.log(size) + 3.0) / weights.sum()
    while True:
        active = np.flatnonzero(clock < limit)
        while len(active):
            block = int(np.clip(2 * limit * heaviest + 3, 3, max(3, (1 << 20) // len(active))))
            steps = np.arange(1, block + 1, dtype=np.uint64) * _STEP
            who, when, count = elements[active], clock[active], drawn[active]
            seeds = shingles.mix((who + count * _STEP)[:, None] + steps)
            # The difference is exact, and a plain logarithm is the faster one.
            gaps = np.log(1.0 - (seeds >> np.uint64(11)) * _UNIT)
            gaps /= -weights[active, None]
            times = np.cumsum(gaps, axis=1)
            times += when[:, None]
            early = times < limit
            inside = early.sum(axis=1)
            where = (shingles.mix(seeds[early]) % np.uint64(size)).astype(np.int64)
            at = times[early]
            np.minimum.at(first, where, at)
            best = at == first[where]
            kept[where[best]] = np.repeat(who, inside)[best]
            # What lies beyond the limit is drawn again if the limit grows.
            drawn[active] = count + inside.astype(np.uint64)
            some = inside > 0
            clock[active[some]] = times[some, inside[some] - 1]
            active = active[inside == block]
        if first.max() < limit:
            return kept
        limit *= 2.0
        # Elements that stopped continue from their last arrival before the old limit.


def describe(text: str | None) -> tuple | None:
    """Keys of the word sequence, and hashes of the bands; None without words."""
    words = shingles.word_hashes(text)
    if not len(words):
        return None
    elements, counts = np.unique(shingles.shingle_hashes(words), return_counts=True)
    kept = signature(elements, 1.0 + np.log2(counts) / 4.0, BANDS * ROWS).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = shingles.mix(h ^ kept[:, i])
    return (*shingles.text_keys(words), h.view(np.int64).tolist())


def _described(texts: pd.Series) -> pd.DataFrame:
    rows = [describe(t) or (None, None, None) for t in texts]
    frame = pd.DataFrame(rows, columns=["key", "key2", "bands"], dtype=object)
    return frame.astype({"key": "Int64", "key2": "Int64"})


def _sets(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        words = shingles.word_hashes(text)
        a, _ = shingles.text_keys(words)
        out.append((a, np.unique(shingles.shingle_hashes(words)).tobytes()))
    return pd.DataFrame(out, columns=["key", "shingles"])


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right, strict=True):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(common / (len(a) + len(b) - common))
    return pd.Series(out, dtype=float)


def _shingle_sets(docs: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) of the texts in ``keys``."""
    keys = cut(keys.distinct(), "keys")
    place = F.xxhash64("doc_id", F.xxhash64("text"))
    wanted = texts.join(keys, "key", "left_semi").select(
        F.xxhash64("place.doc", "place.h").alias("loc"))
    bits = bitmap(wanted, F.col("loc"), "bitmap")
    near = in_bitmap(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), place, bits)
    sets = near.select(F.pandas_udf(_sets, "key bigint, shingles binary")("text").alias("s"))
    return cut(sets.select("s.*").join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _parity(packed: pd.Series) -> pd.Series:
    """PARITY bits: whether an odd number of shingles fall on each.  Those of two sets
    differ in at most as many bits as the sets in shingles."""
    out = []
    for p in packed:
        at = (np.frombuffer(p, np.uint64) & np.uint64(PARITY - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)
        out.append(np.packbits(odd).view(np.int64).tolist())
    return pd.Series(out, dtype=object)


def _most_common(sets: DataFrame) -> DataFrame:
    """(key, size, parity, most): a text's shingles, their parity bits, and how many of them
    any other text of ``sets`` has: no two of these texts can have more in common."""
    def numbers(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, np.int64).tolist() for p in packed], dtype=object)

    rows = sets.select("key", F.explode(F.pandas_udf(numbers, "array<bigint>")("shingles"))
                       .alias("shingle"))
    alone = (rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
             .filter("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("alone")))
    size = (F.octet_length("shingles") / 8).cast("bigint")
    parity = F.pandas_udf(_parity, "array<bigint>")("shingles")
    return sets.select("key", size.alias("size"), parity.alias("parity")).join(
        alone, "key", "left").select(
        "key", "size", "parity", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))


def _linked(docs: DataFrame, texts: DataFrame, pairs: DataFrame, threshold: float,
            sets: DataFrame | None = None) -> DataFrame:
    """The candidate ``pairs`` (a, b: keys of texts) that are similar; ``sets`` may hold
    their shingles already."""
    pairs = cut(pairs.distinct(), "pairs")
    if sets is None:
        sets = _shingle_sets(docs, texts, pairs.select(F.col("a").alias("key")).union(
            pairs.select("b")))
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b"))
    similar = F.pandas_udf(_similar, "double")("sa", "sb")
    return cut(both.filter(similar >= threshold - 1e-12).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key that ``links`` (a, b) connect each key with."""
    edges = cut(links.union(links.select("b", "a")).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select(
        "key", F.least("key", "m").alias("root"))
    labels = cut(labels, "labels")
    while True:
        # The smallest label among the neighbours, then the label's own label.
        seen = edges.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy(
            F.col("a").alias("key")).agg(F.min("root").alias("m"))
        near = labels.join(seen, "key").select(
            "key", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("further"))
        moved = cut(near.join(jump, "root", "left").select(
            "key", "old", F.least("root", "further").alias("root")), "labels")
        labels = moved.select("key", "root")
        if moved.filter(F.col("old") != F.col("root")).isEmpty():
            return labels


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` whose two texts are not in one class."""
    a = roots.select(F.col("key").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("key").alias("b"), F.col("root").alias("rb"))
    return (pairs.distinct().join(a, "a", "left").join(b, "b", "left")
            .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def _relabel(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (key, root) after joining the classes that ``links`` connect."""
    between = (links.join(roots.select(F.col("key").alias("a"), F.col("root").alias("ra")), "a",
                          "left")
               .join(roots.select(F.col("key").alias("b"), F.col("root").alias("rb")), "b", "left")
               .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
               .filter("a != b"))
    joined = components(between).select(F.col("key").alias("root"), F.col("root").alias("to"))
    old = roots.join(joined, "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    new = joined.join(roots.select(F.col("key").alias("root")), "root", "left_anti").select(
        F.col("root").alias("key"), F.col("to").alias("root"))
    return cut(old.union(new), "roots")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct document with words: doc, h (hash of the text), class_doc,
    class_h (the first document of its class) and copies (rows that are this document)."""
    spark = docs.sparkSession
    described = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"),
        F.pandas_udf(_described, "key bigint, key2 bigint, bands array<bigint>")("text").alias("d"))
    signed = cut(described.select("doc", "h", "d.*").filter(F.col("key").isNotNull()), "signed")
    place = F.struct(F.col("doc").isNull().alias("nodoc"), "doc", "h")
    # The second key only guards the first: equal first keys are equal texts.
    texts = cut(signed.groupBy("key", "key2").agg(F.min(F.struct(place.alias("p"), "bands"))
                                                  .alias("x"))
                .select("key", F.col("x.p").alias("place"), "x.bands"), "texts")
    buckets = texts.select("key", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(buckets.join(sizes, "bucket"), "shared")
    weight = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    shared = cut(shared.join(weight, "key").select("key", "bucket", "weight"), "weighed")
    roots = spark.createDataFrame([], "key bigint, root bigint")

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    def star(rank: Column) -> DataFrame:
        rows = rooted(shared)
        centre = rows.groupBy("bucket").agg(F.max_by("key", rank).alias("c"),
                                            F.min("root").alias("lo"), F.max("root").alias("hi"))
        return (rows.join(centre.filter("lo != hi"), "bucket").filter("key != c")
                .select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")))

    roots = _relabel(roots, _linked(docs, texts, star(F.col("weight")), threshold))
    roots = _relabel(roots, _linked(
        docs, texts, _apart(star(F.xxhash64("key", "bucket")), roots), threshold))
    rows = rooted(shared)
    mixed = (rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter("lo != hi").select("bucket"))
    open_rows = cut(rows.join(mixed, "bucket", "left_semi").select("bucket", "key", "root"), "open")
    sets = _shingle_sets(docs, texts, open_rows.select("key"))
    # Each text may only pair up within what it shares with others at all.
    able = open_rows.join(_most_common(sets), "key").filter(
        F.col("most") >= F.col("size") * threshold - 1e-9)
    x, y = able.alias("x"), able.alias("y")
    share = threshold / (1 + threshold)
    differ = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i]))
                  for i in range(PARITY // 64)), F.lit(0))
    pairs = x.join(y, "bucket").filter(
        (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
        & (F.least("x.most", "y.most") >= (F.col("x.size") + F.col("y.size")) * share - 1e-9)
        & (differ <= (F.col("x.size") + F.col("y.size")) * (1 - 2 * share) + 1e-9)
    ).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    roots = _relabel(roots, _linked(docs, texts, pairs, threshold, sets))

    members = rooted(texts.select("key", "place"))
    heads = members.groupBy("root").agg(F.min("place").alias("head"))
    headed = members.join(heads, "root").select("key", "head")
    found = signed.groupBy("doc", "h", "key").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(headed, "key").select(
        "doc", "h", F.col("head.doc").alias("class_doc"), F.col("head.h").alias("class_h"),
        "copies")


def annotate(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of class_id (the doc_id of the
    class's first document), first (this is that document) and copies."""
    name = unused(docs, "near")
    doc, h = unused(docs, "_near_doc"), unused(docs, "_near_h")
    found = classes(docs, threshold)
    first = F.col("doc").eqNullSafe(F.col("class_doc")) & (F.col("h") == F.col("class_h"))
    found = found.select(F.col("doc").alias(doc), F.col("h").alias(h), F.struct(
        F.col("class_doc").alias("class_id"), first.alias("first"), "copies").alias("_near_x"))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(h))
    alone = F.struct(F.col("doc_id").alias("class_id"), F.lit(True).alias("first"),
                     F.lit(1).cast("bigint").alias("copies"))
    joined = docs.join(found, same, "left")
    return joined.select(*[docs[c] for c in docs.columns],
                         F.coalesce(found["_near_x"], alone).alias(name)), name


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, unchanged: its first document."""
    found, name = annotate(docs, threshold)
    kept = found.filter(F.col(name)["first"])
    once = kept.filter(F.col(name)["copies"] == 1)
    repeated = kept.filter(F.col(name)["copies"] > 1).dropDuplicates(["doc_id", "text"])
    return once.union(repeated).drop(name)
