"""Vectorised work on a batch of texts that lie one after another in a single byte buffer.

A batch of strings is a byte array and row offsets, as Arrow holds it, so that no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = (np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~IS_SPACE
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = IS_LETTER[65:91] = True
IS_LETTER[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes (a longer text is a run of its own): first row, end, bytes, offsets."""
    raw, at = buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def fold_case(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters U+00C0 to U+00DE, byte by byte."""
    out = ASCII_LOWER[raw]
    if len(raw) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never cross a row, and the number of runs of each row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[:-1][at[:-1] < n]
    first[edges] |= inside[edges]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] |= inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, at))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n at least; kept for slices of usual size only."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"], _POWERS["down"]
    size, out = max(n, SLICE_BYTES + 1), {}
    for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out[key] = np.multiply.accumulate(factors, out=factors)
    if n <= SLICE_BYTES + 1:
        _POWERS.update(out)
    return out["up"], out["down"]


class Rolling:
    """64-bit polynomial hashes of any byte ranges of one buffer."""

    def __init__(self, raw: np.ndarray):
        up, self._down = _powers(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        codes = _BYTE_CODES[raw]
        codes *= up[: len(raw)]
        np.cumsum(codes, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them over all bits."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
