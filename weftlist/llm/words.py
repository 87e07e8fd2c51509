"""Words and word n-grams of whole texts as numpy arrays.

A batch of texts is one byte buffer with row offsets, so that every step is a vector operation
over all bytes or all words of the batch; there is no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)
_BASE = U(0x9E3779B97F4A7C15)
_SALT = (_rng.integers(1, 2**63, 64, dtype=np.int64) * 2 + 1).astype(U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = [np.ones(1, U), np.ones(1, U)]

#: Bytes of words: everything but ASCII white space, and ASCII letters, digits and all of non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

SLICE_BYTES = 1 << 20


def release() -> None:
    """Gives free memory back to the system: a worker that waits for its next task holds as little as it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back when it is done."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        inverse = U(pow(int(_BASE), -1, 2**64))
        for i, base in enumerate((_BASE, inverse)):
            x = np.full(max(n, SLICE_BYTES + 1), base, U)
            x[0] = 1
            _pow[i] = np.multiply.accumulate(x)
    return _pow[0], _pow[1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; a null is empty.

    A longer text is a run of its own, so memory follows the longest text and not the batch.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of some texts: byte ranges, their text's row, their hashes, and each row's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        rows = len(offs) - 1
        inside = kind[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs[:-1]).astype(np.int64)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.row = np.repeat(np.arange(rows), self.count)
        power, inverse = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.hash = mix(value + (self.end - self.start).astype(U) * _SALT[63])


def grams(words: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every k consecutive words within a row.

    ``short``: a row of fewer words, but not none, gives its whole sequence as one gram.
    """
    n = len(words.hash)
    if n >= k:
        total = words.hash[: n - k + 1] * _SALT[0]
        for j in range(1, k):
            total = total + words.hash[j : n - k + 1 + j] * _SALT[j]
        at = np.flatnonzero(words.row[: n - k + 1] == words.row[k - 1 :])
        value, row = mix(total[at] + U(k)), words.row[at]
    else:
        value, row, at = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((words.count > 0) & (words.count < k))
        if len(few):
            extra = np.array([sequence_hash(words.hash[f : f + c]) for f, c in zip(words.first[few], words.count[few])], U)
            value, row, at = np.append(value, extra), np.append(row, few), np.append(at, words.first[few])
            order = np.argsort(row, kind="stable")
            value, row, at = value[order], row[order], at[order]
    return value, row, at


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The gram hash of a whole sequence of at most 62 words."""
    k = len(hashes)
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(hashes * _SALT[:k], dtype=U) + U(k)], U))[0]


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending; and the row bounds. ``row`` must be ascending."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    value = value.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(rows + 1))
