"""Arrow batches as flat numpy arrays: text bytes, code points, words.

Every helper works on a bounded slice of a batch (``slices``), so the
temporary arrays stay small whatever the batch holds; one very long text is a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes each (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, n]):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and the n + 1 row offsets; null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array and the n + 1 row offsets in code points."""
    data, offsets = utf8(column)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, before[offsets]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row: their starts, ends and row numbers."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (last | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _symbol_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 256) - 1, 0xD1342543DE82EF95, np.uint64)])
    return _POWERS


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes (or small codes) of every run; equal runs have equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens)])
    pos = np.arange(at[-1]) - np.repeat(at[:-1], lens)
    with np.errstate(over="ignore"):
        symbols = data[pos + np.repeat(starts, lens)]
        codes = _symbol_codes()[symbols] if data.dtype == np.uint8 else mix(symbols.astype(np.uint64) + np.uint64(1))
        sums = np.add.reduceat(codes * _powers(int(lens.max()))[pos], at[:-1])
        return mix(sums + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def ranges_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    at = np.cumsum(lens)
    total = int(at[-1]) if len(at) else 0
    return np.arange(total) + np.repeat(starts - (at - lens), lens)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter (Unicode category L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """For every code point, its lower case where that is one code point, else itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table
