"""Hilbert curve positions of points on an integer grid, a block at a time."""

from __future__ import annotations

import numpy as np


def positions(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions (uint64) along the Hilbert curve of rows of an integer grid, dims * bits <= 63.

    Skilling's transform ("Programming the Hilbert curve", 2004): undo excess
    work from the highest bit down, Gray-encode, interleave.
    """
    x = grid.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(level)) & one)
    return out
