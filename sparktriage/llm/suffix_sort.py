"""Suffix sorting by hash comparison: prefix polynomial hashes, extensions by binary search, a mergesort on top."""

from __future__ import annotations

from functools import cache

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < 2^bits."""
    n = 1 << bits
    out = []
    for b in (BASE, BACK):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(12, int(n).bit_length()))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P[i] = sum over j < i of (byte_j + 1) BASE^j mod 2^64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


class Suffixes:
    """Comparison of suffixes of one buffer; each suffix has an end of its own."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        self.prefix = prefix_hashes(raw).tolist()
        self.back = powers(len(raw) + 1)[1]

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether n bytes from a and from b hash alike: one is moved to the other's place by a power of the base."""
        p = self.prefix
        return ((p[a + n] - p[a]) * int(self.back[a]) - (p[b + n] - p[b]) * int(self.back[b])) & MASK == 0

    def extension(self, a: int, a_end: int, b: int, b_end: int) -> int:
        """Length of the longest common prefix of data[a:a_end] and data[b:b_end]."""
        most = min(a_end - a, b_end - b)
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(a, b, mid):
                lo = mid
            else:
                hi = mid - 1
        if self.data[a : a + lo] != self.data[b : b + lo]:  # a collision of the hashes: count byte by byte
            lo = next(i for i in range(most) if self.data[a + i] != self.data[b + i])
        return lo

    def precedes(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        n = self.extension(*x, *y)
        return x[0] + n == x[1] or (y[0] + n < y[1] and self.data[x[0] + n] <= self.data[y[0] + n])

    def sort(self, spans: list[tuple[int, int]]) -> list[int]:
        """Order of the suffixes data[a:end] as indexes, by bottom-up mergesort; equal ones keep their order."""
        runs = [[i] for i in range(len(spans))]
        while len(runs) > 1:
            runs = [self._merge(runs[k], runs[k + 1], spans) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0] if runs else []

    def _merge(self, left: list[int], right: list[int], spans: list[tuple[int, int]]) -> list[int]:
        out, i, j = [], 0, 0
        while i < len(left) and j < len(right):
            if self.precedes(spans[left[i]], spans[right[j]]):
                out.append(left[i])
                i += 1
            else:
                out.append(right[j])
                j += 1
        return out + left[i:] + right[j:]

    def sorted_with_extensions(self, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """The order and the common extension of each neighbouring pair."""
        order = self.sort(spans)
        return order, [self.extension(*spans[a], *spans[b]) for a, b in zip(order, order[1:], strict=False)]
