"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np

_FACTOR, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def hashed_grams(words: list[str], sizes: range | tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of `<word>`, for each size in turn; buckets must be a power of two."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    found, of = [], []
    for k in sizes:
        if len(points) < k:
            continue
        h = np.full(len(points) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * _FACTOR + points[j : len(points) - k + 1 + j]
        own = owner[: len(points) - k + 1]
        inside = own == owner[k - 1 :]
        found.append(((h[inside] * _SPREAD) >> shift).astype(np.int64))
        of.append(own[inside])
    return np.concatenate(found), np.concatenate(of)
