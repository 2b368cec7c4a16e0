"""Benchmark decontamination: remove documents, or spans, that hold test n-grams.

Texts are normalised to lower-case words of ASCII letters and digits and anything
beyond ASCII.  Every run of 13 words of a benchmark text is a window; a shorter
text is one window.  A document word inside any occurrence of a window is hit.

The windows form a hash set that is broadcast.  Its size is checked first: windows
are counted and, above ``BLOCK_WINDOWS``, dealt by hash into as many blocks as keep
each near it.  One block, the usual case, is one pass over the documents with no
shuffle.  With more, driver and tasks hold one block at a time: each has its own
pass, whose hits (only documents that have some) go to a table in the shared folder;
the passes are then united by document and joined back.

Scan: words become numbers of the set's vocabulary, runs of known words that are
long enough get rolling hashes, hash hits are verified word by word.

Defined cases: NULL text or item text has no words; NULL item_id hits words but is
not listed; repeated items or rows change nothing; documents without words are
never contaminated; empty tables give empty or untouched results; further columns
pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, unused

N = 13
# Contaminated: at least one word in 20 is hit.
ONE_IN = 20
# At most so many windows are broadcast at once (about 200 bytes each).
BLOCK_WINDOWS = 500_000
# ... and so many bytes of their text.
BLOCK_BYTES = 64 << 20
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Bytes of UTF-8: letters lower-cased, digits and non-ASCII kept, the rest a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
               else 32 for c in range(256))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_WORD = re.compile(TOKEN)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(window, item): distinct windows of all items; item is item_id as text."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    words = F.regexp_extract_all(lower, F.lit(TOKEN), F.lit(0))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))
    return (rows.filter(F.size("words") > 0)
            .select(F.explode(F.array_distinct(windows)).alias("window"), "item").distinct())


class WindowSet:
    """Hash set of windows: vocabulary, sorted hashes per length, exact owners."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], list[str]] = {}
        for window, item in rows:
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                        for w in window.encode().split())
            owners = self.owners.setdefault(key, [])
            if item is not None:
                owners.append(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for key in self.owners:
            by_length.setdefault(len(key), []).append(key)
        self.hashes = {length: np.unique(rolling(np.array(keys, np.uint64), length)[:, 0])
                       for length, keys in by_length.items()}
        self.least = min(self.hashes, default=0)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        if not self.hashes or len(words) < self.least:
            return hit, items
        find = self.vocabulary.get
        ids = np.fromiter((find(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start < self.least:
                continue
            run = ids[start:end]
            for length, known in self.hashes.items():
                if length > len(run):
                    continue
                h = rolling(run.astype(np.uint64)[None, :], length)[0]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in np.flatnonzero(known[at] == h):
                    owners = self.owners.get(tuple(run[i:i + length].tolist()))
                    if owners is not None:
                        hit[start + i:start + i + length] = True
                        items.update(owners)
        return hit, items


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes modulo 2**64 of all windows of ``length`` along the last axis."""
    count = ids.shape[-1] - length + 1
    h = np.zeros((*ids.shape[:-1], count), np.uint64)
    for i in range(length):
        h = h * _PRIME + ids[..., i:i + count]
    return h


def _without(texts: pd.Series, hits: pd.Series) -> pd.Series:
    done = []
    for text, hit in zip(texts, hits, strict=True):
        if text is None or hit is None or not len(hit):
            done.append(text)
            continue
        spans = [m.span() for m in _WORD.finditer(text.translate(_TO_LOWER))]
        kept, at = [], 0
        breaks = np.flatnonzero(np.diff(hit) > 1)
        for first, last in zip([0, *(breaks + 1)], [*breaks, len(hit) - 1], strict=True):
            kept.append(text[at:spans[hit[first]][0]])
            at = spans[hit[last]][1]
        done.append("".join([*kept, text[at:]]))
    return pd.Series(done, dtype=object)


def _scanner(shared):
    """A column function that looks for one broadcast block of windows."""
    held = {}

    @F.pandas_udf("n_words bigint, hit array<int>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held["set"] = WindowSet(shared.value)
        found = []
        for text in texts:
            words = normal_words(text)
            hit, items = held["set"].scan(words)
            found.append((len(words), np.flatnonzero(hit).tolist(), sorted(items)))
        return pd.DataFrame(found, columns=["n_words", "hit", "items"])
    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N,
              block_windows: int = BLOCK_WINDOWS,
              block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of n_words, hit (indices
    of hit words, ascending) and items (ids of the items whose windows occur)."""
    spark = docs.sparkSession
    name = unused(docs, "hits")
    windows = cut(item_windows(benchmark, n), "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(
        "window")), F.lit(0)).alias("bytes")).first()
    # Windows of long words count by their bytes.
    blocks = max(1, math.ceil(size["n"] / block_windows), math.ceil(size["bytes"] / block_bytes))
    if blocks == 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in windows.collect()])
        return docs.withColumn(name, _scanner(shared)(F.col("text"))), name
    words = F.size(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TOKEN),
                                        F.lit(0)))
    key, passes = [F.col("doc_id"), F.xxhash64("text")], []
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        found = docs.select(key[0].alias("_id"), key[1].alias("_hash"),
                            _scanner(shared)(F.col("text")).alias("_hits"))
        passes.append(cut(found.filter(F.size("_hits.hit") > 0)
                          .select("_id", "_hash", "_hits.hit", "_hits.items"), "hits"))
        shared.destroy()
    united = passes[0]
    for more in passes[1:]:
        united = united.unionByName(more)
    # At most one row a block and distinct document: repeated rows have equal hits.
    own_id, own_hash, hit, items = (unused(docs, c) for c in ("_id", "_hash", "_hit", "_items"))
    united = united.groupBy(F.col("_id").alias(own_id), F.col("_hash").alias(own_hash)).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias(hit),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(items))
    joined = docs.join(united, key[0].eqNullSafe(F.col(own_id))
                       & (key[1] == F.col(own_hash)), "left")
    none = F.array()
    figures = F.struct(F.coalesce(words, F.lit(0)).cast("bigint").alias("n_words"),
                       F.coalesce(hit, none.cast("array<int>")).alias("hit"),
                       F.coalesce(items, none.cast("array<string>")).alias("items"))
    return joined.withColumn(name, figures).drop(own_id, own_hash, hit, items), name


def contaminated(hits: Column) -> Column:
    """The rule on the struct of ``find_hits``."""
    count = F.size(hits["hit"])
    return (count > 0) & (count * ONE_IN >= hits["n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    found, name = find_hits(docs, benchmark)
    return found.filter(~contaminated(F.col(name))).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows, with hit words and what stands between them cut from the texts."""
    found, name = find_hits(docs, benchmark)
    return found.withColumn("text", F.pandas_udf(_without, "string")(
        F.col("text"), F.col(name)["hit"])).drop(name)
