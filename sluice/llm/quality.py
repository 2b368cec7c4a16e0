"""Quality rules: word and repetition counts, and bands of compression ratios.

Zstandard ratios (compressed bytes / bytes) of the whole document and of fixed
chunks are held against limits for their length: below the low limit the text
repeats itself, above the high one it does not look like language.  A document
is rejected when the whole is out of its band, or when more than ``BAD_SHARE`` of its
bytes lie in chunks that are.

One Arrow pass over the text column; the other columns never leave the JVM.  A
task holds one batch (``common.BYTES_PER_BATCH``), or one text if that is
larger.  Nothing is shuffled, so hot sources and lost executors cost no more
than the lost partitions.

Defined cases: NULL text counts as a text without words and fails the base rules
(fewer than 20 words); repeated rows get equal verdicts; an empty table stays
empty; further columns pass through, also under the names used here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import unused

# (up to bytes, low limit, high limit).  Short texts carry the frame's overhead and
# have had no chance to repeat; the bands narrow as texts grow.
BANDS = (
    (127, 0.35, 9.99),
    (255, 0.30, 1.10),
    (511, 0.25, 0.90),
    (1023, 0.22, 0.80),
    (4095, 0.20, 0.75),
    (None, 0.15, 0.70),
)
CHUNK = 4096
# A last chunk shorter than this says little and is left to the whole's ratio.
LEAST_CHUNK = 1024
BAD_SHARE = 1 / 3
LEVEL = 3

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, "
          "bad_chunk_bytes bigint")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words (a power of two) found twice or more.

    Windows are named exactly: words by their rank, then pairs of names by theirs.
    """
    count = len(words) - window + 1
    if count < 2:
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) > len(words) - window:
        # A repeated window repeats all of its words.
        return 0
    width = 1
    while width < window:
        pairs = names[:-width] * np.int64(len(words) + 1) + names[width:]
        names = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    found = np.bincount(names)[names] > 1
    if not found.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    for most, low, high in BANDS:
        if most is None or size <= most:
            return low <= ratio <= high
    return True


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Whole ratio, bytes in chunks out of band, and whether the text passes."""
    if not data:
        return 0.0, 0, False
    ratio = len(packer.compress(data)) / len(data)
    bad = 0
    if len(data) > CHUNK:
        for start in range(0, len(data), CHUNK):
            chunk = data[start:start + CHUNK]
            if len(chunk) >= LEAST_CHUNK and not in_band(
                    len(chunk), len(packer.compress(chunk)) / len(chunk)):
                bad += len(chunk)
    return ratio, bad, in_band(len(data), ratio) and bad <= BAD_SHARE * len(data)


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes: ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in WHITE)
    repeated = repeated_words(words)
    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n_words
    ratio, bad, passes = compression(data, packer)
    return (n_words, word_chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(data),
            repeated, failed, passes and not failed, ratio, bad)


def _verdicts(texts: pd.Series) -> pd.DataFrame:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame([judge(t, packer) for t in texts], columns=columns)


def verdict(text: Column) -> Column:
    """A struct of the counts, ``base_failed``, ``kept`` and the ratios."""
    return F.pandas_udf(_verdicts, SCHEMA)(text)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, unchanged."""
    name = unused(docs, "verdict")
    return (docs.withColumn(name, verdict(F.col("text")))
            .filter(F.col(name)["kept"]).drop(name))
