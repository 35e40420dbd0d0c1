"""Byte-pair merging of many units at once: a hashed table of merges and the two forms of the merge loop."""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

WIDE, ROWS = 48, 16_384
NONE = np.int32(1 << 30)


class MergeTable:
    """Pairs of ids to ranks by open addressing, and the id that each rank makes. Lower ranks merge first.

    An entry holds both ids and the rank, 20 bits each, so one look gives all.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, piece: np.ndarray):
        self.piece = piece.astype(np.int32)
        if max(left.max(initial=0), right.max(initial=0), len(piece)) >= 1 << 20:
            raise ValueError("at most 2^20 pieces")
        key = left.astype(np.int64) << 20 | right
        entry = key << 20 | rank.astype(np.int64)
        self.bits = max(12, (2 * len(key)).bit_length())
        self.entries = np.full(1 << self.bits, -1, np.int64)
        slot, self.probes = self._slot(key), 0
        while len(entry):
            self.probes += 1
            free = np.flatnonzero(self.entries[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.entries[slot[put]] = entry[put]
            left_over = np.ones(len(entry), bool)
            left_over[put] = False
            entry, slot = entry[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs make, NONE where they make none (a or b below 0: no piece)."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), NONE, np.int32)
        at = None
        if (odd := (a < 0) | (b < 0)).any():
            at = np.flatnonzero(~odd)
            key = key[at]
        slot = self._slot(key)
        for _ in range(self.probes):
            there = self.entries.take(slot)
            hit = there >> 20 == key
            if at is None:
                np.copyto(out, (there & 0xFFFFF).astype(np.int32), where=hit)
            else:
                out[at[hit]] = there[hit] & 0xFFFFF
            more = np.flatnonzero(~hit & (there >= 0))
            if not len(more):
                break
            at, key, slot = more if at is None else at[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    @cached_property
    def ranks(self) -> dict[int, int]:
        """Ranks by pair (both ids in 40 bits), to look up one at a time; made when a long unit first comes."""
        held = self.entries[self.entries >= 0]
        return dict(zip((held >> 20).tolist(), (held & 0xFFFFF).tolist(), strict=True))

    @cached_property
    def made(self) -> list[int]:
        return self.piece.tolist()

    def spelled(self, row: list[int]) -> list[int]:
        """A finished row of symbols as ids."""
        return row


def agenda_encode(v: MergeTable, syms: list[int], skip) -> list[int]:
    """One unit by an agenda of candidates; the form for very long units, n log n in their length.

    skip(places, ranks) marks candidates as in encode_units; skip.one(place, rank), if it has that, one alone.
    """
    n, ranks, piece = len(syms), v.ranks, v.made
    sym, nxt, prv = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    one = getattr(skip, "one", skip and (lambda i, r: bool(skip(np.array([i]), np.array([r]))[0])))
    row = np.array(syms, np.int64)
    first = v.merges(row[:-1], row[1:]) if n > 1 else np.zeros(0, np.int32)
    at = np.flatnonzero(first != NONE)
    if skip and len(at):
        at = at[~skip(at, first[at])]
    agenda = [r << 32 | i for r, i in zip(first[at].tolist(), at.tolist(), strict=True)]
    heapq.heapify(agenda)
    due = dict(zip(at.tolist(), first[at].tolist(), strict=True))  # the rank that the pair at a place has now
    while agenda:
        r, i = divmod(heapq.heappop(agenda), 1 << 32)
        if due.get(i) != r:
            continue
        j = nxt[i]
        due.pop(j, None)
        sym[i], nxt[i] = piece[r], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for k in (prv[i], i):
            due.pop(k, None)
            if k >= 0 and nxt[k] < n and sym[k] >= 0 and sym[nxt[k]] >= 0:
                new = ranks.get(sym[k] << 20 | sym[nxt[k]])
                if new is not None and not (one and one(k, new)):
                    due[k] = new
                    heapq.heappush(agenda, new << 32 | k)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def encode_units(v: MergeTable, flat: np.ndarray, size: np.ndarray, skip=None, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat ids of the units, in their order. flat, size: the units' first symbols.

    skip(units, places, ranks) marks the candidates that are skipped, skip.of(unit) those of one unit; None: none are. ranks: those of each symbol with the
    next one, where they are known. Units of a width go together; each round merges the best pair of every one that has any.
    """
    off = size.cumsum() - size
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def finish(own: np.ndarray, sym: np.ndarray) -> None:
        """Rows of symbols padded with -1; those with characters outside the vocabulary are spelled out."""
        odd = (sym < -1).any(1)
        if odd.any():
            for k in np.flatnonzero(odd):
                row = np.array(v.spelled(sym[k][sym[k] != -1].tolist()), np.int32)
                done.append((own[k : k + 1], np.array([len(row)]), row))
            own, sym = own[~odd], sym[~odd]
        real = sym >= 0
        done.append((own, real.sum(1), sym[real]))

    wide = np.where(size <= 16, size, np.where(size <= WIDE, -(-size // 8) * 8, 0))
    for u in np.flatnonzero((wide == 0) & (size > 0)):
        row = np.array(v.spelled(agenda_encode(v, flat[off[u] : off[u] + size[u]].tolist(), skip and skip.of(u))), np.int32)
        done.append((np.array([u]), np.array([len(row)]), row))
    for width in np.unique(wide[wide > 0]).tolist():
        own = np.flatnonzero(wide == width)
        own = own if width <= 16 else own[np.argsort(size[own], kind="stable")]
        for lo in range(0, len(own), ROWS):
            _encode_width(v, flat, size, off, own[lo : lo + ROWS], width, skip, ranks, finish)
    out = np.zeros(len(size), np.int64)
    if not done:
        return out, np.zeros(0, np.int32)
    own, n, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    start = np.zeros(len(size), np.int64)
    out[own], start[own] = n, n.cumsum() - n
    at = np.repeat(start - (out.cumsum() - out), out)
    at += np.arange(len(at))
    return out, ids[at]


def _encode_width(v, flat, size, off, own, width: int, skip, ranks, finish) -> None:
    at = np.empty((len(own), width), np.int8)
    at[:] = np.arange(width, dtype=np.int8)
    take = off[own][:, None] + np.arange(width)
    if width > 16:
        inside = at < size[own][:, None]
        sym = np.where(inside, flat[np.minimum(take, len(flat) - 1)], np.int32(-1))
    else:
        inside, sym = None, flat[take]
    if width == 1:
        finish(own, sym)
        return
    if ranks is None:
        pair = v.merges(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(own), width - 1)
    else:
        pair = ranks[np.minimum(take[:, :-1], len(flat) - 1)]
        if inside is not None:
            pair[~inside[:, 1:]] = NONE
    if skip:
        x, y = np.nonzero(pair != NONE)
        gone = skip(own[x], y, pair[x, y])
        pair[x[gone], y[gone]] = NONE
    while width > 1:
        best = pair.argmin(1)
        rank = pair[np.arange(len(own)), best]
        go = rank != NONE
        if not go.all():
            finish(own[~go], sym[~go])
            sym, at, pair, own, best, rank = sym[go], at[go], pair[go], own[go], best[go], rank[go]
        if not len(own):
            return
        rows = np.arange(len(own))
        sym[rows, best] = v.piece[rank]
        keep = np.ones(sym.shape, bool)
        keep[rows, best + 1] = False
        width -= 1
        sym, at = sym[keep].reshape(len(own), width), at[keep].reshape(len(own), width)
        pair = pair[keep[:, 1:]].reshape(len(own), width - 1)
        left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 1)
        r, p = np.r_[left, right], np.r_[best[left] - 1, best[right]]
        new = v.merges(sym[r, p], sym[r, p + 1])
        if skip:
            hit = np.flatnonzero(new != NONE)
            new[hit[skip(own[r[hit]], at[r[hit], p[hit]], new[hit])]] = NONE
        pair[r, p] = new
    finish(own, sym)
