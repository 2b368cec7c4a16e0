"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: runs of one to three letters
of its lower-cased words, with a mark for a word's edge, hashed into ``BUCKETS`` rows.
Embeddings and softmax are trained together by stochastic gradient descent in numpy
on the driver, on a bounded sample: about ``SAMPLE_ROWS`` dealt evenly to all languages, but
at least about ``LEAST_ROWS`` of each, those of small hash of doc_id and text.  What leaves
the tasks for training are hashed counts, at most ``BUCKETS`` numbers a text.

A fifth of the sample is kept aside to calibrate: a temperature for the scores, and the
rejection threshold, the lowest calibrated score above which ``PRECISION`` of the
predictions are right.  Rejected texts keep their prediction and are marked.

Scoring is one Arrow pass over whole texts, in blocks of ``BLOCK`` characters, so a
task's memory does not grow with a text.  Nothing is shuffled.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0 and
rejected; rows without lang or with NULL text or doc_id are never learned from; no
rows to learn from makes everything ``und``; repeated rows get equal results; further
columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
DIM = 16
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 1500
LEAST_ROWS = 20
TEMPERATURES = tuple(2.0 ** (k / 2) for k in range(-16, 7))
EPOCHS = 12
BATCH = 32
RATE = 1.0
PRECISION = 0.99
BLOCK = 1 << 18
UND = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points are letters (built once per worker)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(codes: np.ndarray) -> np.ndarray:
    """Buckets of all subwords; ``codes`` holds letters, and 0 between words."""
    c = codes.astype(np.uint64)
    found = []
    for order in ORDERS:
        n = len(c) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint64)
        for i in range(order):
            h = (h ^ c[i:i + n]) * _MULTIPLIERS[i % 3]
            h ^= h >> np.uint64(15)
        # An edge of a word may only be the first or the last sign.
        keep = codes[:n] != 0 if order == 1 else np.ones(n, bool)
        for i in range(1, order - 1):
            keep &= codes[i:i + n] != 0
        found.append((h[keep] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def blocks(text: str):
    """Code points of a text, block by block: lower-cased letters, one 0 between words."""
    table = _letter_table()
    for start in range(0, len(text), BLOCK):
        # The last two signs of a block are seen again, so that no subword is lost.
        part = text[max(0, start - 2):start + BLOCK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(table[codes], codes, 0)
        codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
        yield codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and their share of the text's subwords."""
    total = np.zeros(BUCKETS, np.int64)
    for codes in blocks(text or ""):
        if codes.any():
            total += np.bincount(subwords(codes), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (bucket, language): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, text: str | None) -> np.ndarray | None:
        """Calibrated probability of each language; None without a letter."""
        total, n = np.zeros(len(self.langs)), 0
        for codes in blocks(text or ""):
            if codes.any():
                at = subwords(codes)
                total += np.bincount(at, minlength=BUCKETS) @ self.table
                n += len(at)
        return softmax((total / n + self.bias) / self.temperature) if n else None


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[list[int], list[float], str]], seed: int = 7) -> Model | None:
    """Train on (buckets, shares, language)."""
    rows = [r for r in rows if len(r[0])]
    langs = sorted({r[2] for r in rows})
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside = set(order[:len(rows) // 5].tolist()) if len(rows) >= 10 else set()
    learn = [i for i in range(len(rows)) if i not in aside]
    y = np.array([langs.index(r[2]) for r in rows])
    rare = 1.0 / np.bincount(y, minlength=len(langs))
    weight = rare[y] / rare[y].mean()
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))

    def dense(batch):
        x = np.zeros((len(batch), BUCKETS))
        for k, i in enumerate(batch):
            x[k, rows[i][0]] = rows[i][1]
        return x

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(learn), BATCH):
            if not start:
                rng.shuffle(learn)
            batch = learn[start:start + BATCH]
            x = dense(batch)
            seen = np.flatnonzero(x.any(0))
            x = x[:, seen]
            h = x @ embed[seen]
            error = softmax(h @ soft + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            error *= weight[batch][:, None] / len(batch)
            # Averages are small: embeddings take larger steps than the softmax.
            step = x.T @ (error @ soft.T)
            soft -= rate * 4 * (h.T @ error)
            bias -= rate * error.sum(0)
            embed[seen] -= rate * 40 * step
    table = embed @ soft
    held = sorted(aside) or list(range(len(rows)))
    z = np.array([rows[i][1] @ table[rows[i][0]] + bias if isinstance(rows[i][1], np.ndarray)
                  else np.array(rows[i][1]) @ table[rows[i][0]] + bias for i in held])
    # As if one of so many predictions had been wrong: what is told apart without error would
    # otherwise be called certain.
    slip = 1.0 / (len(held) + 2)
    goal = np.full(z.shape, slip / max(1, len(langs) - 1))
    goal[np.arange(len(held)), y[held]] = 1.0 - slip
    losses = {t: -(goal * np.log(softmax(z / t) + 1e-300)).sum(1).mean() for t in TEMPERATURES}
    temperature = min(losses, key=lambda t: (losses[t], t))
    p = softmax(z / temperature)
    best, right = p.max(1), p.argmax(1) == y[held]
    threshold = 1.0
    for t in np.sort(best):
        if right[best >= t].mean() >= PRECISION:
            threshold = float(t)
            break
    return Model(langs, table, bias, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    """Never learned from: the CRC-32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, most: int = SAMPLE_ROWS) -> Model | None:
    """A model from the rows with text and lang that are not held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                         & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not known:
        return None
    # Every language is learned, from about as many rows each: those whose hash is small, so
    # reruns take the same ones.  Texts are not shuffled; repeated rows count once.
    each, spread = max(LEAST_ROWS, math.ceil(most / len(known))), 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(known.items())
                           for x in (lang, int(spread * min(1.0, each / n)))])
    h = F.xxhash64("doc_id", F.lit("lang"), "text")
    sample = (usable.select("doc_id", "lang", "text", h.alias("h"))
              .filter(F.pmod("h", F.lit(spread)) < F.element_at(share, F.col("lang")))
              .dropDuplicates(["lang", "h"]))

    def count_all(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=["at", "share"])

    rows = sample.select("doc_id", "lang", "h", F.pandas_udf(
        count_all, "at array<int>, share array<float>")(F.col("text")).alias("c"))
    found = sorted(((r["doc_id"], r["lang"], r["h"], r["c"]["at"], r["c"]["share"])
                    for r in rows.collect()), key=lambda r: r[:3])
    return fit([(at, shares, lang) for _, lang, _, at, shares in found])


def predict(text: Column, model: Model | None) -> Column:
    """A struct lang_pred, score, rejected."""
    def score(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            p = model.scores(text) if model is not None else None
            if p is None:
                out.append((UND, 0.0, True))
            else:
                best = int(p.argmax())
                out.append((model.langs[best], float(p[best]),
                            bool(p[best] < model.threshold)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
    return F.pandas_udf(score, "lang_pred string, score double, rejected boolean")(text)
