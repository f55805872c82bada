"""Hilbert curve keys of points on a grid, vectorised over rows."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve (uint64) of integer points cells[n, d], 0 <= cell < 2**bits, bits * d <= 63.

    The transpose form of the curve: undo the excess rotations from the highest bit down, Gray-decode across the
    dimensions, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key
