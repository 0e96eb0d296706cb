"""Words and their hashes for whole Arrow batches of texts, as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; in UTF-8 that is the run of such characters. A word's
hash is a polynomial over random 64-bit byte values, mixed at the end, so equal
words have equal hashes in any task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_VALUES = np.random.default_rng(20_240_611).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER_VALUES = _BYTE_VALUES[LOWER]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U)
                    for b in (self.base, self.inverse)
                )
        return self.up[:n], self.down[:n]


_BYTES = Powers(0x9E3779B97F4A7C1B)
_WORDS = Powers(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers = _WORDS) -> np.ndarray:
    """A hash of ``values[begin:end]`` for each pair, by prefix sums."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U) * U(0x632BE59BD9B4E019))


@dataclass
class Scan:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text begins and the last one ends
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hashes: np.ndarray  # one per word
    first: np.ndarray  # number of words before each text, and of all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def scan(texts: pa.Array, lower: bool = False) -> Scan:
    """Words of every whole text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0])
    data = np.frombuffer(data, np.uint8)[low : int(offsets[-1])] if data else np.zeros(0, np.uint8)
    offsets = offsets - low
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = True
        after[offsets[1:][filled] - 1] = True
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    values = (_LOWER_VALUES if lower else _BYTE_VALUES)[data]
    hashes = spans_hash(values, begin, end, _BYTES)
    return Scan(data, offsets, begin, end, hashes, np.searchsorted(begin, offsets))


_SECOND = Powers(0xC2B2AE3D27D4EB4F)
_SECOND_VALUES = np.random.default_rng(20_250_123).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def second_hashes(s: Scan) -> np.ndarray:
    """Another hash of each word, with other byte values and another base."""
    return spans_hash(_SECOND_VALUES[s.data], s.begin, s.end, _SECOND)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices with about ``limit`` bytes of ``text``, one row at least.

    Bounds the arrays of a task; only a single longer text goes beyond.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, owner) of every window of ``size`` consecutive words within one text."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    return begin, owner


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
