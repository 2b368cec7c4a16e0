"""Word shingles of a text as 64-bit numbers, by numpy, without a Python loop per word.

Words are those of the decontamination operator: letters and digits, lower-cased,
ASCII punctuation as a separator.  Memory is bounded by ``BLOCK`` bytes of text plus
eight bytes per word.
"""

from __future__ import annotations

import numpy as np

from sluice.llm.decontam import _TABLE

BLOCK = 1 << 19
WIDTH = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.uint64(30), np.uint64(27), np.uint64(31)
_FACTORS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + _GOLD
    moved = x >> _SHIFTS[0]
    x ^= moved
    x *= _FACTORS[0]
    np.right_shift(x, _SHIFTS[1], out=moved)
    x ^= moved
    x *= _FACTORS[1]
    np.right_shift(x, _SHIFTS[2], out=moved)
    x ^= moved
    return x


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the bytes; powers of an odd base and of its inverse modulo 2**64."""
    global _tables
    if _tables is None:
        base, size = 0xD6E8FEB86659FD93, 2 * BLOCK
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _tables = (mix(np.arange(256, dtype=np.uint64)), np.cumprod(up), np.cumprod(down))
    return _tables


def word_hashes(text: str | None) -> np.ndarray:
    """One number per word, equal for equal words."""
    data = (text or "").encode().translate(_TABLE)
    number, up, down = _powers()
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            space = data.rfind(b" ", at, end)
            # A word longer than a block is cut; both parts are words then.
            end = space + 1 if space >= at else end
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], part != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64),
                               np.cumsum(number[part] * up[:len(part)], dtype=np.uint64)))
        found.append(mix((sums[ends] - sums[starts]) * down[starts]
                         + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One number per run of ``width`` words; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        h = mix(h ^ words[i:i + len(h)])
    return h


def text_keys(words: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the sequence of words."""
    placed = mix(words ^ (np.arange(len(words), dtype=np.uint64) * _GOLD))
    total = np.array([placed.sum(dtype=np.uint64), mix(placed).sum(dtype=np.uint64)], np.uint64)
    a, b = mix(total + np.uint64(len(words))).view(np.int64).tolist()
    return a, b
