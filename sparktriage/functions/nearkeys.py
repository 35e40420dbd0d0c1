"""Keys under which two names that score at least a limit are sure to meet: a set-similarity join on letters with counts.

A name's letters with counts (the first e, the second e, ...) are a set; two names of lengths m and n share s of them. Either score
bounds s from below:
- a token-sort ratio of t needs 2 s / (m + n) >= t; a Jaro-Winkler of t without a common start needs (s/m + s/n + 1) / 3 >= t, which
  is the weaker of both: class 0;
- a Jaro-Winkler of t with p common first letters (1 to 4) needs a Jaro of 1 - (1 - t) / (1 - p/10), more than 0.7 and less than t, so a
  smaller s, but both names start with the same p letters: class p.
For the lengths (m, n) a class thus asks for s >= need(m, n). Of two sets in a common order that share s members, the first m - s + j of one
and the first n - s + j of the other share at least j. A key is the class, both lengths, the common start and j members of that
prefix: a pair within the limit has an equal key, and few other pairs do. Any order of the letters is right; with rare ones first,
fewest pairs meet. Names of more than EXACT letters have geometric bands of lengths and one member a key.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations

import numpy as np

CLASSES = 5
TOGETHER = (3, 2, 1, 0, 0)  # members of a key, by class
EXACT, BAND = 24, 1.15


def letter_set(name: str) -> list[str]:
    """The letters of a name, the k-th of a kind with its number."""
    seen: dict[str, int] = {}
    out = []
    for c in name:
        seen[c] = k = seen.get(c, 0) + 1
        out.append(f"{c}{k}")
    return out


@lru_cache(1 << 12)
def band(m: int) -> tuple[int, int]:
    """Least and greatest length of the lengths that m is taken together with."""
    if m <= EXACT:
        return m, m
    lo = EXACT + 1
    while (hi := int(lo * BAND)) < m:
        lo = hi + 1
    return lo, hi


def need(m: int, n: int, limit: float, start: int) -> int:
    """Letters that a pair of these lengths shares at least, if it scores the limit by way of the class. It grows with m and n."""
    least = 3 * (max(0.7, 1 - (1 - limit) / (1 - 0.1 * start)) if start else limit) - 1
    return max(1, start, math.ceil(least * m * n / (m + n) - 1e-6))


@lru_cache(1 << 14)
def _plan(lo: int, hi: int, limit: float, start: int, most: int) -> list[tuple[int, int, int]]:
    """(least length of the other side's band, shared letters needed, members a key), for all bands that can match."""
    out, n = [], 1
    while n <= most:
        a, z = band(n)
        s = need(lo, a, limit, start)
        if s <= min(hi, z):
            out.append((a, s, min(TOGETHER[start] if hi <= EXACT and z <= EXACT else min(1, TOGETHER[start]), s)))
        n = z + 1
    return out


@lru_cache(1 << 12)
def _chosen(n: int, j: int) -> np.ndarray:
    return np.array(list(combinations(range(n), j)), np.int64).reshape(-1, j)


@lru_cache(1 << 16)
def _mark(what: str) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def near_keys(name: str, letters: list[str], limit: float, most: int, first: bool) -> np.ndarray:
    """Keys of a name, as 64-bit hashes. letters: its letter set in the common order; first: its side of a pair; most: the greatest length on the other side."""
    lo, hi = band(len(name))
    marks = np.array([_mark(x) for x in letters], np.int64)
    out = []
    for start in range(min(CLASSES, len(name) + 1)):
        plan, head = _plan(lo, hi, limit, start, most), name[:start]
        if plan and not TOGETHER[start]:
            out.append(np.array([_mark(f"{start} {head}")], np.int64))
            continue
        for n, s, j in plan:
            if s <= len(name):
                held = _chosen(len(name) - s + j, j) if j > 1 else np.arange(len(name) - s + 1)[:, None]
                out.append(marks[held].sum(1) + np.int64(_mark(f"{start} {lo} {n} {head}" if first else f"{start} {n} {lo} {head}")))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
