"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's hash is
a polynomial over its bytes modulo 2**64 with a fixed odd base, taken from prefix
sums of the whole buffer and then mixed, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; longer documents form a step of their own.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PowerTable:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = _powers(_BASE, n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), n)
        return self.up, self.down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n+1 row offsets of a string array; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def lower_table() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def white_table() -> np.ndarray:
    white = np.zeros(256, dtype=bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return white


class Tokens(NamedTuple):
    """All tokens of some rows: hashes, byte ranges from the first row's start, and n+1 offsets into them by row."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def tokens(raw: np.ndarray, offsets: np.ndarray, powers: PowerTable, fold: np.ndarray, gap: np.ndarray) -> Tokens:
    """Maximal runs of bytes that are no ``gap``, after ``fold``. ``offsets`` may start anywhere in ``raw``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = fold[raw[lo:hi]]
    rows = offsets - lo
    if not len(data):
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Tokens(hashes, starts, ends, np.searchsorted(starts, rows).astype(np.int64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, powers: PowerTable) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and n+1 offsets into them."""
    found = tokens(raw, offsets, powers, lower_table(), white_table())
    return found.hashes, found.bounds


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive hashes."""
    n = max(len(hashes) - size + 1, 0)
    out = hashes[:n].copy()
    for i in range(1, size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[i : n + i])
    return out


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles.

    A row with fewer words has its whole sequence as its one shingle; a row
    without words has none.
    """
    runs = chained(words, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield mix(chained(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int, powers: PowerTable) -> Iterator[np.ndarray]:
    raw, offsets = buffers(texts)
    for a, b in steps(offsets):
        words, bounds = word_hashes(raw, offsets[a : b + 1], powers)
        yield from shingle_hashes(words, bounds, size)
