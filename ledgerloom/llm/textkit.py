"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the raw UTF-8 buffers that Arrow hands to a Python worker, so a batch of documents is one
``uint8`` array plus document offsets and no per-word Python object is made.  All hashes are 64-bit sums of
position-weighted random byte values modulo 2**64 (so that any substring's hash follows from two prefix sums),
finished by a bijective mixer.  The tables are derived from a fixed rule, so every worker computes equal values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed)) * U(_BASE))


BYTE_VALUE = stream(11, 256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64; kept for the next call."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _pow, _inv = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _pow, _inv


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null reads as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or of one longer document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes that ``blank`` doesn't mark; runs end with their document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~blank[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


class Hasher:
    """Hashes of any substrings of a byte array, or of any runs of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        values = BYTE_VALUE[symbols] if symbols.dtype == np.uint8 else symbols
        power, self.inverse = powers(len(values) + 1)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` symbols, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + U(size))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


class Anchors:
    """Windows of ``length`` symbols, told apart by the least ``key``-symbol run that each holds.

    ``first``..``last`` (inclusive) are the starts of consecutive windows of one document that pick the run at
    ``at``; equal windows pick runs at equal places, so whatever two windows can be equal share the run's hash and
    the distance to it.  ``doc`` is the document, ``key`` the hash of the run, ``context`` that of all the symbols
    that the windows hold together with the place of the run.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, length: int, key: int, hasher: Hasher | None = None):
        hasher = hasher or Hasher(symbols)
        width, n = length - key + 1, len(symbols)
        hashes = hasher.windows(key)
        bits = max(1, int(n).bit_length())
        low = U((1 << bits) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_minimum(ranked, width)
        lengths = np.diff(offsets)
        inside = np.zeros(n + 1, np.int64)
        long = lengths >= length
        inside[offsets[:-1][long]] += 1
        np.add.at(inside, offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(inside)[: len(least)] > 0
        starts = np.flatnonzero(valid)
        picked = (least[starts] & low).astype(np.int64)
        doc = np.searchsorted(offsets, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(starts)) - 1 if len(heads) else heads
        self.first, self.last = starts[heads], starts[tails]
        self.at, self.doc = picked[heads], doc[heads]
        self.key = hashes[self.at] if len(heads) else np.zeros(0, np.uint64)
        place = (self.at - self.first).astype(np.uint64) * U(_BASE)
        self.context = mix(hasher(self.first, self.last + length) + place)
