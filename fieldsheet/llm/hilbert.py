"""Hilbert curve positions of points with integer coordinates, for whole arrays at once."""

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of every row of ``points`` (n x dims, each below 2**bits, dims * bits <= 63).

    Skilling's method ("Programming the Hilbert curve", 2004): coordinates are turned in place into
    the transposed index, whose bits are then interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out
