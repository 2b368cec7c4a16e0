"""Quality classifier: random Fourier features of document statistics, ridge, isotonic curve.

Every whole text becomes ``len(NAMES)`` statistics, taken piece by piece (``PIECE``
characters), so a task's memory does not grow with a text.  Standardised statistics go
through ``FEATURES`` random cosines, whose products approximate a Gaussian kernel of width
sqrt(number of statistics).  Tasks add up the normal equations of the ridge regression of
the labels, one set per fold of the documents; sums of partitions are added again in tasks,
and the driver solves systems of FEATURES + 1 unknowns.  The ridge is the one with the least
error on left-out folds, read off the same sums.  Scores of left-out folds, counted in
``BINS`` bins, give the isotonic curve from score to probability.

All labelled rows are learned from; no bound on their number is needed.

Labels: quality 0 or 1 per doc_id; several rows of a doc_id count by their mean; NULL and
other values are no labels; rows with NULL doc_id have none.  Only documents whose
crc32(doc_id) mod 5 is not 0 are learned from.  NULL text counts as empty; empty texts get the
score of their statistics, all 0.  Without labels every score is 0.5.  Repeated rows get
equal scores.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut
from sluice.operators.skew import lookup

PIECE = 1 << 20
FEATURES = 256
FOLDS = 4
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
BINS = 2048
# Scores beyond these ends share the outer bins.
LOWEST, HIGHEST = -0.5, 1.5
FARTHEST = 6.0
POSITIVE = 0.3

NAMES = ("log_words", "log_lines", "word_mean", "word_deviation", "log_longest", "upper",
         "capital_words", "digits", "punctuation", "symbols", "symbol_ends", "digit_words",
         "letterless_words", "exclamations", "ended_lines", "again_lines", "log_line_length",
         "distinct_words", "top_word", "entropy", "packed", "foreign", "blanks", "vowels",
         "stutter")
LOWER, UPPER, DIGIT, BLANK, MARK, SYMBOL = range(1, 7)
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Kind of each code point (built once per worker)."""
    global _kinds
    if _kinds is None:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                table[i] = DIGIT
        table[[9, 10, 11, 12, 13, 32]] = BLANK
        table[[ord(c) for c in "!\"'(),-.:;?"]] = MARK
        table[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = SYMBOL
        _kinds = table
    return _kinds


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of up to PIECE characters, cut after a line or a blank if there is one."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            at = max(text.rfind("\n", start, end), text.rfind(" ", start, end))
            end = at + 1 if at > start else end
        yield text[start:end]
        start = end


def of_piece(text: str) -> tuple[int, np.ndarray]:
    """Number of words, and the statistics of one piece."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    n = len(codes)
    blank = kind == BLANK
    inside = np.concatenate(([False], ~blank, [False]))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return 0, np.zeros(len(NAMES))
    words, lengths = text.split(), (ends - starts).astype(float)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[ends] - total[starts]

    upper, letters = per_word(kind == UPPER), per_word((kind == UPPER) | (kind == LOWER))
    many = len(starts)
    count = np.bincount(kind, minlength=SYMBOL + 1)
    n_letters = max(1, count[LOWER] + count[UPPER])
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    times = Counter(words)
    used = np.bincount(np.minimum(codes, 1023))
    share = used[used > 0] / n
    raw = text.encode("utf-8", "surrogatepass")
    vowels = np.isin(codes | 32, [ord(c) for c in "aeiou"]) & (kind != SYMBOL)
    return many, np.array([
        math.log1p(many), math.log1p(len(lines)), lengths.mean(), lengths.std(),
        math.log(lengths.max()), count[UPPER] / n_letters,
        np.mean((upper > 1) & (upper == letters)), count[DIGIT] / n, count[MARK] / n,
        count[SYMBOL] / n, np.mean(kind[ends - 1] == SYMBOL),
        np.mean(per_word(kind == DIGIT) > 0), np.mean(letters == 0),
        np.count_nonzero(codes == 33) / many,
        sum(x[-1] in ".!?:;\"')" for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))), len(times) / len(words) if words else 0.0,
        max(times.values(), default=0) / max(1, len(words)), -(share * np.log2(share)).sum(),
        len(zlib.compress(raw, 1)) / len(raw),
        np.count_nonzero((codes > 127) & ((kind == LOWER) | (kind == UPPER))) / n_letters,
        count[BLANK] / n, vowels.sum() / n_letters,
        sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)])


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text: means over its pieces by words, sums in the first two."""
    parts = [of_piece(p) for p in pieces(text or "")]
    many = sum(n for n, _ in parts)
    if not many:
        return np.zeros(len(NAMES))
    x = sum(n * v for n, v in parts) / many
    x[0] = math.log1p(many)
    x[1] = math.log1p(sum(math.expm1(v[1]) for _, v in parts))
    return x


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x, row)``: the statistics of every document, once, in the shared folder."""
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return cut(docs.select(F.col(ident).alias("doc_id"),
                           F.pandas_udf(each, "array<double>")(F.col(text)).alias("x"),
                           F.monotonically_increasing_id().alias("row")), "statistics")


def held_out(ident: Column) -> Column:
    """Whether nothing is learned from a document; NULL ids are never learned from."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fold, x, y)`` of the documents to learn from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
                           & ~held_out(F.col("doc_id")))
    per_doc = usable.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    joined = lookup(measured, per_doc, ["doc_id"], spread=["row"]).filter(F.col("y").isNotNull())
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return cut(joined.select(fold.alias("fold"), "x", "y"), "labelled")


@dataclass
class Model:
    """From statistics to a probability."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    fold_weights: np.ndarray | None = None
    scores: np.ndarray | None = None
    curve: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -FARTHEST, FARTHEST)
        cosines = np.cos(z @ self.waves + self.shift) * math.sqrt(2 / self.waves.shape[1])
        return np.hstack((cosines, np.ones((len(x), 1))))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        return np.interp(raw, self.scores, self.curve)


def empty_model(measured: DataFrame, seed: int = 12) -> Model:
    """Means and deviations over all documents, and the random waves."""
    n = len(NAMES)
    at = [F.col("x")[i] for i in range(n)]
    found = measured.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)],
                         *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    mean = np.array([found[f"m{i}"] or 0.0 for i in range(n)])
    spread = np.array([found[f"s{i}"] or 1.0 for i in range(n)])
    rng = np.random.default_rng(seed)
    # Standardised rows are sqrt(2 n) apart on average: that sets the kernel's width.
    return Model(mean, np.maximum(spread, 1e-9), rng.normal(0, 1 / math.sqrt(n), (n, FEATURES)),
                 rng.uniform(0, 2 * math.pi, FEATURES))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal_equations(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold the matrix [Z y]' [Z y], of which each task sums its own rows.

    Level two adds the sums up by row of the matrix, so that the driver gets one matrix a fold.
    """
    side = FEATURES + 2
    schema = "fold int, i int, sums binary"

    def emit(total: dict) -> Iterator[pa.RecordBatch]:
        for fold, i in sorted(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold], pa.int32()), pa.array([i], pa.int32()),
                 pa.array([total[fold, i].tobytes()], pa.binary())], names=["fold", "i", "sums"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False)
            z = np.hstack((model.features(_matrix(batch.column("x"))), y[:, None]))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                mine = z[fold == f]
                total[int(f)] = total.get(int(f), 0.0) + mine.T @ mine
        yield from emit({(f, i): m[i] for f, m in total.items() for i in range(side)})

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, i, sums in zip(*(batch.column(c).to_pylist() for c in ("fold", "i", "sums"))):
                total[f, i] = total.get((f, i), 0.0) + np.frombuffer(sums)
        yield from emit(total)

    parts = rows.select("fold", "x", "y").mapInArrow(of_rows, schema)
    found: dict[int, np.ndarray] = {}
    for r in parts.repartition("fold", "i").mapInArrow(of_sums, schema).collect():
        found.setdefault(r["fold"], np.zeros((side, side)))[r["i"]] = np.frombuffer(r["sums"])
    return found


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights; the constant is not held back."""
    n = sums[-2, -2]
    held = np.full(len(sums) - 1, max(ridge * n, 1e-9))
    held[-1] = 1e-9
    return np.linalg.solve(sums[:-1, :-1] + np.diag(held), sums[:-1, -1])


def squared_error(sums: np.ndarray, w: np.ndarray) -> float:
    return float(sums[-1, -1] - 2 * w @ sums[:-1, -1] + w @ sums[:-1, :-1] @ w)


def isotonic(at: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing curve of least squared error: pooled neighbours, at their mean places."""
    pools: list[list[float]] = []
    for a, s, w in zip(at, share, weight):
        pools.append([a * w, s * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    return (np.array([p[0] / p[2] for p in pools]),
            np.array([min(1.0, max(0.0, p[1] / p[2])) for p in pools]))


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents of ``measured``."""
    model = empty_model(measured)
    rows = labelled(measured, labels)
    folds = normal_equations(rows, model)
    if not folds:
        return model
    total = sum(folds.values())
    without = {f: total - s if len(folds) > 1 else s for f, s in folds.items()}

    def error(ridge: float) -> float:
        return sum(squared_error(s, solve(without[f], ridge)) for f, s in folds.items())

    ridge = min(RIDGES, key=error)
    model.weights = solve(total, ridge)
    model.fold_weights = np.array([solve(without.get(f, total), ridge) for f in range(FOLDS)])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            z = model.features(_matrix(batch.column("x")))
            raw = (z * model.fold_weights[fold]).sum(axis=1)
            place = (np.clip(raw, LOWEST, HIGHEST) - LOWEST) / (HIGHEST - LOWEST) * BINS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(place.astype(np.int32), BINS - 1)), pa.array(raw),
                 batch.column("y")], names=["bin", "raw", "y"])

    bins = sorted(rows.mapInArrow(left_out, "bin int, raw double, y double").groupBy("bin").agg(
        F.avg("raw").alias("at"), F.avg("y").alias("share"), F.count("y").alias("n")).collect())
    model.scores, model.curve = isotonic(*(np.array([r[c] for r in bins], float)
                                           for c in ("at", "share", "n")))
    return model


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every measured document."""
    def each(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(x.to_list())) if len(x) else [], dtype=float)

    score = F.pandas_udf(each, "double")("x")
    found = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                            score.alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= POSITIVE, 1).otherwise(0))
