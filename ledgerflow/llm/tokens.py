"""Vectorised word hashing over Arrow string columns (numpy, inside Spark tasks).

Words are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A word's hash is a polynomial over random 64-bit byte codes, mixed with its length; two
different words share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19  # bytes worked on at once; a longer document is a slice of its own

_codes = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_codes[ord("A"):ord("Z") + 1] = _codes[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(raw: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets per row) of the rows in one slice."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    n, at = len(data), 0
    while at < n:
        end = min(at + SLICE, n)
        if end < n:  # cut before a blank or a row, so that no word is cut
            stop = _break_before(data, offsets, at, end)
            end = stop if stop > at else _break_after(data, offsets, end)
        h, starts = _words(data[at:end], offsets[(offsets > at) & (offsets < end)] - at)
        hashes.append(h)
        rows = np.searchsorted(offsets, starts + at, side="right") - 1
        counts += np.bincount(rows, minlength=len(counts))
        at = end
    total = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), total


def _break_before(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
    blank = np.flatnonzero(SPACE[data[max(at, end - 65536):end]])
    row = offsets[np.searchsorted(offsets, end, side="right") - 1]
    return max(int(row), max(at, end - 65536) + int(blank[-1]) if len(blank) else 0)


def _break_after(data: np.ndarray, offsets: np.ndarray, end: int) -> int:
    row = int(offsets[np.searchsorted(offsets, end, side="left")])
    while end < row:
        blank = np.flatnonzero(SPACE[data[end:min(row, end + 65536)]])
        if len(blank):
            return end + int(blank[0])
        end = min(row, end + 65536)
    return row


def _words(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    blank = SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = row_starts[~blank[row_starts]]
    first[inner] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    value = _codes[data]
    value *= powers(_BASE, n)[:n]
    value[blank] = 0
    sums = np.add.reduceat(value, starts) * powers(_INVERSE, n)[starts]
    length = np.add.reduceat((~blank).astype(np.int64), starts).astype(np.uint64)
    return mix(sums + length * np.uint64(0xD6E8FEB86659FD93)), starts


def hash_word(word: bytes) -> int:
    """The hash of a single word, for tests and fixed marks."""
    h, _ = _words(np.frombuffer(word, np.uint8), np.zeros(0, np.int64))
    return int(h[0])
