"""Rolling hashes, and anchors by the least of them."""

from __future__ import annotations

import numpy as np

#: Symbols hashed at a time, and how far the last window of a block may reach beyond it.
BLOCK, REACH = 1 << 18, 400

_U = np.uint64
_M64 = (1 << 64) - 1


class Rolling:
    """Polynomial hashes modulo 2**64 of all windows of a length, for one odd base."""

    def __init__(self, base: int, seed: int, size: int = BLOCK + REACH):
        self.size = size
        self.symbol = np.random.RandomState(seed).randint(0, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        up = np.full(size, base, _U)
        up[0] = 1
        self.up = np.cumprod(up, dtype=_U)
        down = np.full(size, pow(base, -1, 1 << 64), _U)
        down[0] = 1
        self.down = np.cumprod(down, dtype=_U)

    def summed(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def prefix(self, b: np.ndarray) -> np.ndarray:
        return self.summed(self.symbol[b])

    def window(self, prefix: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[at]) * self.down[at]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


_tables: list[Rolling] = []


def rolling() -> list[Rolling]:
    if not _tables:
        _tables.extend((Rolling(0x5851F42D4C957F2D, 1), Rolling(0x2545F4914F6CDD1D, 2)))
    return _tables


def anchors(core: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``wide`` hashes in a row the place of the least, the first of equal ones: runs ``start, end, anchor``
    of windows with the same."""
    n = len(core)
    windows = n - wide + 1
    key = (core >> _U(20) << _U(20)) | np.arange(n, dtype=_U)
    grid = np.concatenate([key, np.full(-n % wide, _M64, _U)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows]) & _U(0xFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return start, np.append(start[1:], windows), least[start]
