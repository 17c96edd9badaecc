"""Names of substrings: polynomial prefix sums give a 64-bit name of any substring in constant time, for all positions at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers and seeds of two independent families of names.
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits; 0 is kept free as 'no name'."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.where(x == 0, np.uint64(1), x)


@lru_cache(4)
def byte_table(family: int = 0) -> np.ndarray:
    return np.random.default_rng(1000 + family).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(family: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a family's base and of its inverse: one table per family, as long as the longest block so far."""
    if family not in _POWERS or len(_POWERS[family][0]) < size:
        _POWERS.pop(family, None)
        base = BASE[family]
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _POWERS[family] = (np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down))
    up, down = _POWERS[family]
    return up[:size], down[:size]


class Names:
    """Names of the substrings of a sequence of uint64 symbols."""

    def __init__(self, symbols: np.ndarray, family: int = 0):
        up, self.down = _powers(family, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """The names of [start, start + length)."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        """The names of all substrings of one length, by their start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[:n] + np.uint64(length)) if n > 0 else np.zeros(0, np.uint64)


def sliding(op, x: np.ndarray, n: int) -> np.ndarray:
    """op (minimum or maximum) over x[i:i + n] for each i, by doubling."""
    k = 1
    while 2 * k <= n:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[:len(x) - (n - k)], x[n - k:]) if k < n else x


def anchors(names: np.ndarray, ends: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the grams that are the least of some window of that many symbols within one document.

    names: by position, of grams (shorter at the end by gram - 1); ends: by position, the end of its document.
    Two equal windows have their least grams at the same places, so no repeated window is without a repeated anchor.
    """
    n = window - gram + 1
    if len(names) < n:
        return np.zeros(0, np.int64)
    at = np.arange(len(names))
    names = np.where(at + gram <= ends[:len(names)], names, np.uint64(2**64 - 1))
    least = sliding(np.minimum, names, n)
    least[at[:len(least)] + window > ends[:len(least)]] = 0
    around = np.zeros(len(names) + n - 1, np.uint64)
    around[n - 1:n - 1 + len(least)] = least
    return np.flatnonzero(sliding(np.maximum, around, n) == names)


def words(data: np.ndarray, starts: np.ndarray, family: int = 0, separators: bytes = b" \t\n\r\x0b\x0c", keep: np.ndarray | None = None):
    """(begin, end, document, name) of the words of a block: runs of bytes that are no separators (or for which keep is true)."""
    if keep is None:
        table = np.ones(256, bool)
        table[list(separators)] = False
        keep = table
    inside = keep[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    begin = np.flatnonzero(inside & (~before[:-1] | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    doc = np.searchsorted(starts, begin, "right") - 1
    return begin, end, doc, Names(byte_table(family)[data], family).of(begin, end - begin)
