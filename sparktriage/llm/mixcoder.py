"""Range coder over mixed order-0 to order-2 predictions of ids, for many independent blocks in step.

A segment lists what it has counted: its ids (order 0), the ids that came twice or more after an id (order 1), and those that came twice or
more after two ids (order 2), for the pairs where that saves more bits than the list takes. Counts stand as logarithms. From the lists both sides
make one table of chances a context, in whole numbers:
- after an id: (count + the id's chance of order 0) / (all counts + 1);
- after a listed pair: (count + 2 times the chance after the pair's second id) / (all counts + 2);
- what a table leaves, 1 part of 2^16 at least, goes to all ids by their chance of order 0, so that any id can follow any other.
A block starts without a context and needs the segment's lists, but nothing of other blocks; it has a checksum. One step of a 64-bit range coder codes
an id. All blocks of a segment take their steps together, one numpy lane each. An entry of a table names the table of the next step, so a
decoder looks no context up. Carries go into digits already out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
BLOCK = 2048  # ids at most
BITS = 32  # of a table's shares and order 0's frequencies together
LOW, LAST16 = np.uint64(1 << 32), np.uint64((1 << 16) - 1)
_1, _16, _32 = np.uint64(1), np.uint64(16), np.uint64(32)
CELLS = 1 << 16  # ids whose intervals are made at once
COUNT = np.rint(2.0 ** (np.arange(256) / 4))


def _logs(count: np.ndarray) -> np.ndarray:
    return np.rint(4 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def _kind(n: int) -> type:
    """Of keys below n: half the memory where that will do."""
    return np.uint32 if n < (1 << 32) - 1 else np.int64


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each came."""
    key = np.sort(key)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at].astype(np.int64), np.diff(np.r_[at, len(key)])


class _Places:
    """Keys to their places in a list, by open addressing; -1 for other keys."""

    def __init__(self, keys: np.ndarray, kind: type):
        self.bits, self.kind, self.none = max(8, (3 * len(keys)).bit_length()), kind, np.iinfo(kind).max
        keys = keys.astype(kind)
        self.keys, self.at = np.full(1 << self.bits, self.none, kind), np.full(1 << self.bits, -1, np.int32)
        slot, place = self._slot(keys), np.arange(len(keys))
        while len(place):
            free = np.flatnonzero(self.at[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.at[slot[put]] = keys[place[put]], place[put]
            rest = np.ones(len(place), bool)
            rest[put] = False
            place, slot = place[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        if self.kind is np.uint32:
            return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), np.int32)
        for k in range(0, len(keys), 1 << 15):  # parts that stay in the processor's cache
            out[k : k + (1 << 15)] = self._part(keys[k : k + (1 << 15)].astype(self.kind, copy=False))
        return out

    def _part(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there, out = self.keys.take(slot), self.at.take(slot)
        more = np.flatnonzero(there != keys)
        out[more] = -1
        more = more[there[more] != self.none]
        while len(more):
            slot[more] = slot[more] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[more]]
            hit = there == keys[more]
            out[more[hit]] = self.at[slot[more[hit]]]
            more = more[~hit & (there != self.none)]
        return out


def _order0_bits(n: int) -> int:
    return min(max((4 * n).bit_length(), 16), 20)


def _listed(row: np.ndarray, count: np.ndarray, rows: int, most: int) -> np.ndarray:
    """Which entries (in order of row) a table lists: those that came twice or more, the most frequent if there are too many; order 0 codes the others."""
    keep = count > 1
    if (np.bincount(row[keep], minlength=rows) > most).any():
        at = np.flatnonzero(keep)
        at = at[np.lexsort((-count[at], row[at]))]
        first = np.searchsorted(row[at], row[at])
        keep[at[np.arange(len(at)) - first >= most]] = False
    return keep


def _shares(whole: int, row: np.ndarray, count: np.ndarray, left: np.ndarray, lower: np.ndarray, weight: float) -> np.ndarray:
    """Chances of entries in parts of a whole, rounded down, 1 at least: counts and weight times the lower order's chance, with the counts that are left to others."""
    rows = len(left)
    m = np.bincount(row, minlength=rows)
    total = np.bincount(row, count, rows) + left + weight  # whole numbers below 2^53: exact in any order
    return 1 + np.floor((whole - 1 - m)[row] * ((count + weight * lower) / total[row])).astype(np.int64)


class Tables:
    """What a segment lists, and the tables made of it. Ids are places in its list of ids; table n of n ids and more belong to pairs, the last one to the start of a block."""

    def __init__(self, ids, logs, m1, left1, next1, logs1, pairs, m2, left2, next2, logs2):
        self.lists = (ids, logs, m1, left1, next1, logs1, pairs, m2, left2, next2, logs2)
        self.ids, self.n = ids.astype(np.uint32), len(ids)
        p = COUNT[logs]
        self.bits = _order0_bits(self.n)
        self.all0, self.whole = 1 << self.bits, 1 << BITS - self.bits
        own = np.floor(p / p.sum() * (self.all0 - self.n)).astype(np.int64) + 1
        self.cum0 = np.r_[0, own.cumsum()]
        self.cum0[-1] = self.all0
        self.own0 = np.diff(self.cum0)
        self.row1, self.next1 = np.repeat(np.arange(self.n), m1), next1
        self.share1 = _shares(self.whole, self.row1, COUNT[logs1], COUNT[left1] - 1, self.own0[next1] / self.all0, 1.0)
        self.key1 = self.row1 * self.n + next1
        self.pairs, self.next2 = pairs, next2

    def follow(self) -> None:
        """The second order, and all tables one after another."""
        _, _, m1, left1, next1, logs1, pairs, m2, left2, next2, logs2 = self.lists
        n, key1 = self.n, self.key1
        row2 = np.repeat(np.arange(len(pairs)), m2)
        last2 = next1[pairs]  # the second id of each pair
        lower = np.searchsorted(key1, last2[row2] * n + next2)
        share2 = _shares(self.whole, row2, COUNT[logs2], COUNT[left2] - 1, self.share1[np.minimum(lower, max(0, len(key1) - 1))] / self.whole, 2.0)
        rows = n + len(pairs) + 1
        self.start_row, self.last = rows - 1, np.r_[np.arange(n), last2, n]
        size = np.r_[m1, m2, 0] + 1  # with what is left to order 0
        self.first = np.r_[0, size.cumsum()]
        self.rest = self.first[1:] - 1  # where a table's rest stands
        total = int(self.first[-1])
        listed = np.ones(total, bool)
        listed[self.rest] = False
        row = np.repeat(np.arange(rows), size)
        self.sym = np.full(total, n, np.int64)
        self.sym[listed] = np.r_[next1, next2]
        share = np.zeros(total, np.int64)
        share[listed] = np.r_[self.share1, share2]
        share[self.rest] = self.whole - np.bincount(row, share, rows).astype(np.int64)
        start = share.cumsum() - share
        start -= start[self.first[:-1]][row]
        if share.min() < 1 or self.sym[listed].max(initial=0) >= n:
            raise ValueError("the lists are damaged")
        self.place1, self.place2 = np.flatnonzero(listed & (row < n)), np.flatnonzero(listed & (row >= n))
        self.key2 = (row * n + self.sym)[self.place2]
        self.begin = start
        self.pair_keys = key1[pairs]
        then = np.where(listed, self.after(row, self.sym), rows)  # the table after an entry; there is none of this number
        self.packed_entries = (then << 32 | share - 1 << 16 | start).view(np.uint64)
        self.row, self.size = row, size

    def after(self, row: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The tables that ids lead to from tables."""
        if not len(self.pair_keys):
            return sym.copy()
        want = self.last[row] * self.n + sym
        at = self.pair_keys.searchsorted(want)
        return np.where(self.pair_keys.take(at, mode="clip") == want, self.n + at, sym)

    @classmethod
    def of(cls, ids: np.ndarray, steps: int) -> tuple[Tables, np.ndarray, np.ndarray]:
        """The tables, and for each id its place and its entry. Blocks of so many ids start anew."""
        held, count = _counted(ids)
        n, at = len(held), np.zeros(int(held[-1]) + 1, np.uint32)
        at[held] = np.arange(n)
        x, kind = at.take(ids), _kind(n * n)
        key = x.astype(kind)
        key[1:] += x[:-1].astype(kind) * kind(n)
        inside = np.ones(len(x), bool)
        inside[::steps] = False
        kinds, came = _counted(key[inside])
        keep = _listed(kinds // n, came, n, 1 << BITS - 2 - _order0_bits(n))
        left1 = np.bincount(kinds[~keep] // n, came[~keep], n) + 1
        key1, came1 = kinds[keep], came[keep]
        no, no_logs = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        first = cls(held, _logs(count), np.bincount(key1 // n, minlength=n), _logs(left1), key1 % n, _logs(came1), no, no, no_logs, no, no_logs)
        pair = _Places(key1, kind)(key)
        pair[::steps] = -1
        del key
        out = cls(*first.lists[:6], *first._second(x, pair, steps))
        out.follow()
        to = np.full(len(key1) + 1, -1, np.int32)
        to[out.pairs] = n + np.arange(len(out.pairs))
        row = np.empty(len(x), np.int32)
        row[0], row[1:] = -1, to.take(pair[:-1])
        row[::steps] = -1
        entry = np.r_[out.place1, -1].astype(np.int32).take(pair)
        two, kind = np.flatnonzero(row >= 0), _kind((n + len(out.pairs)) * n)
        own = _Places(out.key2, kind)(row[two].astype(kind) * kind(n) + x[two])
        entry[two] = np.r_[out.place2, -1].astype(np.int32).take(own)
        rest = np.flatnonzero(entry < 0)
        table = np.where(row[rest] >= 0, row[rest], x[rest - 1].astype(np.int32))
        table[~inside[rest]] = out.start_row
        entry[rest] = out.rest[table]
        return out, x, entry

    def _second(self, x: np.ndarray, pair: np.ndarray, steps: int) -> tuple[np.ndarray, ...]:
        """Lists of the pairs whose own table saves more bits than it takes."""
        n, pairs = self.n, len(self.key1)
        known = pair[:-1] >= 0
        known[steps - 1 :: steps] = False
        kind = _kind(pairs * n)
        kinds, came = _counted(pair[:-1][known].astype(kind) * kind(n) + x[1:][known])
        row = kinds // n
        keep = _listed(row, came, pairs, self.whole >> 2)
        total, held = np.bincount(row, came, pairs), np.bincount(row[keep], came[keep], pairs)
        good = ((2 * held >= total) & (held >= 4 * np.bincount(row[keep], minlength=pairs)))[row]  # where few ids come again, a table saves nothing
        kinds, came, row, keep = kinds[good], came[good], row[good], keep[good]
        sym, left2 = kinds % n, np.bincount(row[~keep], came[~keep], pairs) + 1
        last = self.next1[row]
        place = _Places(self.key1, np.int64)(last * n + sym)
        keep &= place >= 0
        room = self.whole - np.bincount(self.row1, self.share1, n)
        p0 = self.own0 / self.all0
        one = np.where(place >= 0, np.r_[self.share1, 0][place], room[last] * p0[sym])
        two = np.zeros(len(row))
        two[keep] = _shares(self.whole, row[keep], came[keep], left2 - 1, one[keep] / self.whole, 2.0)
        room2 = self.whole - np.bincount(row, two, pairs)
        two[~keep] = (room2[row] * p0[sym])[~keep]
        saved = np.bincount(row, came * np.log2(two / one), pairs) - 12 * np.bincount(row[keep], minlength=pairs)
        use = np.flatnonzero(saved > 24)
        mine = keep & np.isin(row, use)
        return use, np.bincount(row[mine], minlength=pairs)[use], _logs(left2[use]), sym[mine], _logs(came[mine])

    def packed(self) -> bytes:
        ids, logs, m1, left1, next1, logs1, pairs, m2, left2, next2, logs2 = self.lists
        wide = (np.diff(ids, prepend=0), m1, _gaps(next1, m1), np.diff(pairs, prepend=0), m2, _gaps(next2, m2))
        planes = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in wide)
        sizes = struct.pack("<IIII", len(ids), len(next1), len(pairs), len(next2))
        return zlib.compress(sizes + planes + b"".join(a.astype(np.uint8).tobytes() for a in (logs, left1, logs1, left2, logs2)), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Tables:
        try:
            raw = zlib.decompress(data)
            n, k1, pairs, k2 = struct.unpack_from("<IIII", raw)
            if len(raw) != 16 + 4 * (2 * n + k1 + 2 * pairs + k2) + 2 * n + k1 + pairs + k2:
                raise ValueError("the lists are damaged")
            at, out = 16, []
            for m in (n, n, k1, pairs, pairs, k2):
                out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at).reshape(4, m).T).view("<u4").ravel().astype(np.int64))
                at += 4 * m
            for m in (n, n, k1, pairs, k2):
                out.append(np.frombuffer(raw, np.uint8, m, at))
                at += m
            ids, m1, next1, pairs, m2, next2, logs, left1, logs1, left2, logs2 = out
            tables = cls(ids.cumsum(), logs, m1, left1, _sums(next1, m1), logs1, pairs.cumsum(), m2, left2, _sums(next2, m2), logs2)
            tables.follow()
            tables.guides()
        except (zlib.error, struct.error, IndexError) as e:
            raise ValueError("the lists are damaged") from e
        return tables

    def guides(self) -> None:
        """For each table, where its equal parts begin, so that an entry is found at once or nearly so."""
        bits = np.minimum(np.ceil(np.log2(4 * self.size)).astype(np.int64), BITS - self.bits)
        shift, cells = BITS - self.bits - bits, 1 << bits
        guide_at = cells.cumsum() - cells
        self.guide_at = guide_at << 5 | shift
        self.flat = self.row * self.whole + self.begin  # all tables' starts, ascending
        row = np.repeat(np.arange(len(bits)), cells)
        value = np.arange(len(row)) - guide_at[row] << shift[row]
        self.guide = (np.searchsorted(self.flat, row * self.whole + value, side="right") - 1).astype(np.int32)


def _gaps(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Differences inside rows of m ascending numbers; a row's first number stands as it is."""
    out = np.diff(x, prepend=0)
    first = (m.cumsum() - m)[m > 0]
    out[first] = x[first]
    return out


def _sums(gaps: np.ndarray, m: np.ndarray) -> np.ndarray:
    total = np.r_[0, gaps.cumsum()]
    return total[1:] - np.repeat(total[m.cumsum() - m], m)


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """One segment: magic, sizes, its lists, a checksum and a digit count for each block, digits."""
    n = len(ids)
    if vocab > 1 << 19:
        raise ValueError("at most 524,288 ids")
    lanes = -(-n // BLOCK)
    steps = -(-n // lanes) if lanes else 0
    lanes = -(-n // steps) if lanes else 0
    if not lanes:
        return struct.pack("<4sIQIII", MAGIC, vocab, n, steps, lanes, 0)
    raw = np.ascontiguousarray(ids, "<u4")
    crc = np.array([zlib.crc32(raw[k : k + steps]) for k in range(0, n, steps)], "<u4")
    padded = np.full(lanes * steps, ids[-1], np.uint32)
    padded[:n] = ids
    del raw
    tables, x, entry = Tables.of(padded, steps)
    del padded
    listed = tables.packed()
    head = struct.pack("<4sIQIII", MAGIC, vocab, n, steps, lanes, len(listed)) + listed
    used, digits = _encoded(tables, x.reshape(lanes, steps), entry.reshape(lanes, steps))
    return head + crc.tobytes() + used.astype("<u4").tobytes() + digits


def _encoded(t: Tables, x: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, bytes]:
    lanes, steps = x.shape
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    digit, out, carry = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), bool), np.empty((steps, lanes), bool)
    cum0, own0, bits, none = t.cum0.astype(np.uint64), t.own0.astype(np.uint64), np.uint64(t.bits), np.uint64(t.start_row + 1)
    many = max(1, CELLS // lanes)
    for k in range(0, steps, many):
        e = np.ascontiguousarray(entry[:, k : k + many].T)
        w = t.packed_entries.take(e)
        start, freq = (w & LAST16) << bits, (w >> _16 & LAST16) + _1 << bits
        rest = np.nonzero(w >> _32 == none)
        s, room = x[:, k : k + many].T[rest], freq[rest] >> bits
        start[rest] += room * cum0[s]
        freq[rest] = room * own0[s]
        for j in range(len(e)):
            r = size >> _32
            new = low + r * start[j]
            np.less(new, low, out=carry[k + j])
            size = r * freq[j]
            gone = np.less(size, LOW, out=out[k + j])
            np.copyto(digit[k + j], new.view(np.uint32)[1::2])
            shift = gone * _32
            low = new << shift
            size <<= shift
    out, carry = np.ascontiguousarray(out.T), np.ascontiguousarray(carry.T)
    used = np.count_nonzero(out, axis=1) + 2
    begin = used.cumsum() - used
    flat, ends = np.zeros(int(used.sum()), np.int64), begin + used
    place = np.ones(len(flat), bool)
    place[ends - 1] = place[ends - 2] = False
    flat[place] = digit.T[out]
    flat[ends - 2], flat[ends - 1] = low >> _32, low & (LOW - np.uint64(1))
    at = np.flatnonzero(carry)  # a carry goes to the digit before
    done = out.cumsum(axis=1, dtype=np.int32).ravel()[at] - out.ravel()[at] + begin[at // steps] - 1
    flat += np.bincount(done, minlength=len(flat))
    while (over := np.flatnonzero(flat >> 32)).size:
        flat[over] &= (1 << 32) - 1
        flat[over - 1] += 1
    return used, flat.astype("<u4").tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is damaged."""
    size = struct.calcsize("<4sIQIII")
    if len(data) < size:
        raise ValueError("a segment is cut short")
    magic, _, n, steps, lanes, listed = struct.unpack_from("<4sIQIII", data)
    if magic != MAGIC:
        raise ValueError("not a segment of ids")
    if not n:
        return np.zeros(0, np.uint32)
    if not 0 < steps <= BLOCK or lanes != -(-n // steps):
        raise ValueError("sizes are damaged")
    at = size + listed
    if len(data) < at + 8 * lanes or (len(data) - at) % 4:
        raise ValueError("a segment is cut short")
    tables = Tables.unpacked(data[size:at])
    crc = np.frombuffer(data, "<u4", lanes, at)
    used = np.frombuffer(data, "<u4", lanes, at + 4 * lanes).astype(np.int64)
    flat = np.frombuffer(data, "<u4", -1, at + 8 * lanes)
    if len(flat) != used.sum():
        raise ValueError("a segment is cut short")
    raw = _decoded(flat, used.cumsum() - used, steps, tables)[:n].astype("<u4")
    if any(zlib.crc32(raw[k * steps : (k + 1) * steps]) != c for k, c in enumerate(crc.tolist())):
        raise ValueError("a block fails its checksum")
    return raw


def _decoded(flat: np.ndarray, place: np.ndarray, steps: int, t: Tables) -> np.ndarray:
    lanes, flat = len(place), np.r_[flat, np.zeros(2, np.uint32)]
    rel = flat[place].astype(np.uint64) << _32 | flat[place + 1]
    size, place = np.full(lanes, ~np.uint64(0)), place + 2
    grid, most = np.zeros((steps, lanes), np.int32), np.uint64((1 << BITS) - 1)
    row, bits, whole, none = np.full(lanes, t.start_row), np.uint64(t.bits), t.whole, t.start_row + 1
    cum0, own0 = t.cum0.astype(np.uint64), t.own0.astype(np.uint64)
    for k in range(steps):
        r = size >> _32
        v = np.minimum(rel // r, most)
        hi = (v >> bits).view(np.int64)
        g = t.guide_at.take(row)
        e = t.guide.take((hi >> (g & 31)) + (g >> 5))
        w = t.packed_entries.take(e)
        a, f = w & LAST16, (w >> _16 & LAST16) + _1
        if (far := np.flatnonzero((a + f).view(np.int64) <= hi)).size:
            w[far] = x = t.packed_entries.take(t.flat.searchsorted(row[far] * whole + hi[far], side="right") - 1)
            a[far], f[far] = x & LAST16, (x >> _16 & LAST16) + _1
        a <<= bits
        then = (w >> _32).view(np.int64)
        if (out := np.flatnonzero(then == none)).size:  # by order 0
            room, base = f[out], a[out]
            own = cum0.searchsorted((v[out] - base) // room, side="right") - 1
            then[out] = t.after(row[out], own)
            a[out] = base + room * cum0[own]
            f <<= bits
            f[out] = room * own0[own]
        else:
            f <<= bits
        rel -= r * a
        size = r * f
        more = np.flatnonzero(size < LOW)
        at = place[more]
        rel[more] = rel[more] << _32 | flat.take(at, mode="clip")
        size[more] <<= _32
        place[more] = at + 1
        grid[k] = row = then
    return t.ids[t.last[:-1].take(np.ascontiguousarray(grid.T).ravel())]
