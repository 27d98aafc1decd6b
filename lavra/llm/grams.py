"""Character n-grams of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

#: Multiplier of the rolling hash.
_STEP = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the text number of each."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    return points, np.repeat(np.arange(len(texts), dtype=np.int64), lengths)


def hashes(points: np.ndarray, owner: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and text number of every n-gram of ``order`` that lies inside one text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        h = h * _STEP + points[k : k + n].astype(np.uint64)
    h = (h * _MIX) >> np.uint64(64 - bits)
    inside = owner[:n] == owner[order - 1 : order - 1 + n]
    return h[inside].astype(np.int64), owner[:n][inside]
