"""Hashed byte n-gram features, shared by the classifiers."""

from __future__ import annotations

import numpy as np

_KEEP = np.full(256, 32, np.uint8)
_KEEP[128:] = np.arange(128, 256)
for _r in (range(ord("a"), ord("z") + 1),):
    _KEEP[list(_r)] = list(_r)


def letters(text: str | None) -> np.ndarray:
    """Lower-cased bytes; ASCII other than letters become one space, runs collapsed,
    with a space at both ends."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", np.uint8)
    b = _KEEP[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep]


CHUNK = 1 << 20


def chunks(b: np.ndarray, sizes: tuple[int, ...], bits: int):
    """The buckets of every n-gram, once each, size by size for a stretch of the text at a time: an
    n-gram belongs to the stretch in which it starts."""
    for at in range(0, len(b), CHUNK):
        for n in sizes:
            yield hashed(b[at : at + CHUNK + n - 1], (n,), bits)[0]


def hashed(b: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Per n-gram size the bucket, below 2**bits, of each n-gram in order.

    Hashes of all sizes share the buckets; the size seeds the hash.
    """
    out, x = [], b.astype(np.uint64)
    for n in sizes:
        if len(b) < n:
            out.append(np.empty(0, np.int64))
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + x[i : len(b) - n + 1 + i] + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out
