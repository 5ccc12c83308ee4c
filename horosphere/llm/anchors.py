"""Content-chosen cuts of byte strings: every 50-byte window belongs to one anchor, chosen by the window's bytes alone."""

from __future__ import annotations

import numpy as np

#: Bytes of a window, of an anchor, and the anchors among which a window takes the least.
WINDOW, GRAM = 50, 20
STARTS = WINDOW - GRAM + 1
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; data has 8 bytes more than the last place needs."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def window_hash(data: np.ndarray, at: np.ndarray, turn: int = 0) -> np.ndarray:
    """A hash of the window from each place; another one for each turn."""
    z = np.full(len(at), np.uint64(turn))
    for k, step in enumerate((0, 8, 16, 24, 32, 40, 42)):
        z = mixed(z + words_at(data, at + step) * _C[(k + turn) % len(_C)])
    return z


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: documents' bytes, one after another, and 64 bytes more; bounds: where each starts, and the end. For each maximal
    run of windows of one document with the same anchor: the anchor's place, the run's first and last window."""
    n = int(bounds[-1])
    m = n - WINDOW + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none, none
    grams = m + STARTS - 1
    w = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    z = w[:grams] * _C[0]
    z ^= z >> np.uint64(31)
    z += w[8 : grams + 8]
    z *= _C[1]
    z ^= z >> np.uint64(31)
    z += w[GRAM - 8 : grams + GRAM - 8]
    z *= _C[2]
    z &= np.uint64(0xFFFFFFFF00000000)
    z |= np.arange(grams, dtype=np.uint64)  # of equal ones the first
    have = 1
    while have < STARTS:
        step = min(have, STARTS - have)
        z = np.minimum(z[:-step], z[step:])
        have += step
    anchor = (z & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that reach over a document's end belong to none
    inner = bounds[1:-1]
    ok = np.ones(m, bool)
    if len(inner):
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(inner - WINDOW + 1, 0), 1)
        np.add.at(mark, inner, -1)
        ok = np.cumsum(mark)[:m] == 0
    start = ok.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(start)
    stop = ok.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:]
    return anchor[first], first, np.flatnonzero(stop)
