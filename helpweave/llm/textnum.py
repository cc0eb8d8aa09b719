"""Numpy helpers over Arrow text columns: chunks, word bounds, span hashes, minimum sampling.

All functions work on whole batches of concatenated UTF-8 bytes; no loop runs over single rows or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task (a single longer text is handled alone). The arrays made of a chunk take some 60 times
#: as much, and an idle worker keeps part of them, so a chunk is small; rows are handled alone, so its size changes no result.
CHUNK = 1 << 18
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 5  # odd, and BASE - 1 is divisible by 4 only
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII blanks; every other byte belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each code span; equal spans have equal hashes wherever they stand."""
    raw = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` codes from each position on."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:n]) * powers(INVERSE, len(prefix))[:n] + np.uint64(width))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, limit: int = CHUNK):
    """Yield ``first row, last row, bytes, bounds`` for runs of rows of about ``limit`` bytes."""
    data, bounds = buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1))
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def fresh(name: str, taken) -> str:
    """``name``, with marks in front if a column is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


class Words:
    """Words of a chunk: byte spans, hashes and the word bounds of every document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, blank: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        n = len(data)
        inside = ~blank[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            at = bounds[:-1][bounds[:-1] < n]
            first[at] = inside[at]
            at = bounds[1:][bounds[1:] > 0] - 1
            last[at] = inside[at]
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, bounds)
        self.hash = span_hash(prefix_sums(BYTE_CODE[data]), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from every word on, and whether they stand in one document."""
        return code_windows(self.hash, self.bounds, width)


def code_windows(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = rolling_hash(prefix_sums(codes), width)
    left = np.repeat(bounds[1:], np.diff(bounds))[: len(h)] - np.arange(len(h))
    return h, left >= width


def sampled(h: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the (leftmost) least hash of some run of ``span`` positions of one document.

    ``whole[i]`` says that position ``i`` may be used; runs with unusable positions are left out.
    Equal runs choose equal places, and every run holds a chosen place.
    """
    n = len(h)
    if n < span:
        return np.zeros(0, np.int64)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(~whole, out=bad[1:])
    ok = bad[span:] == bad[: n - span + 1]
    at = (low[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(at):
        at = np.unique(at) if len(at) < 2 else at[np.r_[True, at[1:] != at[:-1]]]
    return at


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``values`` as binary cells."""
    size = values.dtype.itemsize
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * size, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
