"""Vectorised window hashes over one-dimensional integer sequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(b), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (unsigned 64-bit), from prefix sums of a polynomial."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, (n + 1).bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * down[: n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
