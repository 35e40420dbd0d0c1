"""Interned units and their ids in one growing flat array, gathered for whole batches at once."""

from __future__ import annotations

import numpy as np


class Interned(dict):
    """unit -> number, in order of first sight."""

    def __missing__(self, unit):
        n = self[unit] = len(self)
        return n


def grown(a: np.ndarray, n: int, fill=0) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.full(max(n, 2 * len(a), 1024), fill, a.dtype)
    out[: len(a)] = a
    return out


class Ragged:
    """Rows of ids by slot; a slot that was never set has length -1."""

    def __init__(self):
        self.flat, self.used = np.zeros(1024, np.int32), 0
        self.off, self.size = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)

    def missing(self, slots: np.ndarray) -> np.ndarray:
        self.size = grown(self.size, int(slots.max()) + 1 if len(slots) else 0, -1)
        new = np.zeros(len(self.size), bool)
        new[slots] = True
        return np.flatnonzero(new & (self.size < 0))

    def put(self, slots: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.off, self.size = grown(self.off, len(self.size)), grown(self.size, int(slots.max()) + 1 if len(slots) else 0, -1)
        self.off = grown(self.off, len(self.size))
        self.flat = grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.off[slots] = self.used + sizes.cumsum() - sizes
        self.size[slots] = sizes
        self.used += len(flat)

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the slots' rows and the rows one after another."""
        size = self.size[slots]
        at = np.repeat(self.off[slots] - (size.cumsum() - size), size)
        at += np.arange(len(at))
        return size, self.flat[at]
