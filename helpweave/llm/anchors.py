"""Content-chosen anchors: equal windows of codes, wherever they stand, name the same place inside them."""

from __future__ import annotations

import numpy as np

from helpweave.llm.textnum import code_windows


def window_anchors(codes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every ``width``-code window of one row: its start, its anchor's place, and the hash of the ``gram`` codes there.

    The anchor is the leftmost gram of least hash among those inside the window.
    """
    h, _ = code_windows(codes, bounds, gram)
    span = width - gram + 1
    n = len(codes) - width + 1
    if n <= 0 or len(h) < span:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    start = np.flatnonzero(np.arange(n) + width <= end)
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return start, place, h[place]


def among(rows: np.ndarray, grams: np.ndarray, shared_rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether each gram of a row is in that row's list of shared grams."""
    code = lambda r, g: g + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    have = np.sort(code(shared_rows, shared))
    if not len(have):
        return np.zeros(len(grams), bool)
    ask = code(rows, grams)
    return have[np.minimum(np.searchsorted(have, ask), len(have) - 1)] == ask


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
