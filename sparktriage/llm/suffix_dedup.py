"""Exact removal of repeated byte strings: a suffix sort dealt out over the cluster by content.

Every 200-byte string of a text has one anchor, the k-gram of least hash inside it, so equal strings have equal anchors at
equal places. Neighbouring strings with the same anchor form one span. Copies of a span inside a batch are known before the shuffle:
one stands for them. The rest are dealt by anchor:
- spans of one anchor that are wholly equal repeat in full. Inside a batch equal digests are followed by a comparison of
  the bytes; between batches anchor, place and a digest of 128 bits must agree (no bytes move for them);
- where an anchor has spans that differ (the edges of repeats), one of each kind is fetched and the group's suffixes from
  the anchor and the reversed prefixes before it are sorted by hash comparison (suffix_sort, which verifies every extension
  by bytes). Merging neighbours of the suffix order from long to short common extensions, smaller set into larger, pairs
  each span with its nearest ones in prefix order; from both extensions follows which of its strings start elsewhere too.
- a group of more than GROUP kinds is not held by one task: it is split by a second anchor, the k-gram of least hash under
  another hash, equal parts are joined by their bytes, and the parts are sorted as above; so again for LEVELS times. What is
  still larger then is counted string by string, by bytes, with partial sums.

Defined results: null text is empty; texts under `length` bytes lose nothing; repeated rows are repeats of each other;
overlapping repeats inside a document count; strings are judged on the input; extra columns are ignored by op2.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .suffix_sort import Suffixes, powers, prefix_hashes

LENGTH = 200
GRAM = 40
PIECE = 1 << 20
PLACE_BITS = 22  # of an anchor's place among the bytes looked at together
MOST = 1 << PLACE_BITS
GROUP, LEVELS = 20_000, 3
_DIGEST = xxhash.xxh3_128_digest


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchored_spans(data: np.ndarray, ends: np.ndarray, length: int, gram: int, seed: int = 0):
    """Spans of a buffer of texts that end at `ends`: arrays of first string, number of strings, anchor place, anchor hash."""
    n, w = len(data), length - gram + 1
    if n > MOST:
        raise ValueError(f"places have {PLACE_BITS} bits: {n} bytes at once are too many")
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    p = prefix_hashes(data)
    h = _mixed((p[gram:] - p[:-gram]) * powers(n + 1)[1][: n - gram + 1] + np.uint64(seed))
    low = np.uint64(MOST - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # the rightmost of equal hashes is least
    full = np.full(-(-len(key) // w) * w, ~np.uint64(0))
    full[: len(key)] = key
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    at = (low - (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low)).astype(np.int64)
    room = np.repeat(ends, np.diff(np.r_[0, ends]))[:m] - np.arange(m)
    ok = room >= length
    new = ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1]]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.r_[(at[1:] != at[:-1]) | ~ok[1:], True]) + 1
    return first, stop - first, at[first], h[at[first]]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of rows (lo, hi) with the byte to start from; a text over PIECE bytes comes in overlapping parts, alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        for start in range(offsets[lo], max(offsets[hi] - length + 1, offsets[lo] + 1) if hi == lo + 1 else offsets[lo] + 1, PIECE):
            yield lo, hi, start
        lo = hi


def _copies(anchor: np.ndarray, same: np.ndarray, text: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal spans are neighbours, and which ones equal the one before. Where spans of equal digests differ
    in bytes, all of that digest get another by their bytes (same is changed), until only equal bytes are left together."""
    turn = 0
    while True:
        order = np.lexsort((same[:, 1], same[:, 0], anchor))
        a, s = anchor[order], same[order]
        again = np.r_[False, (a[1:] == a[:-1]) & (s[1:] == s[:-1]).all(1)]
        at = np.flatnonzero(again)
        clash = [k for k, i, j in zip(at.tolist(), order[at].tolist(), order[at - 1].tolist(), strict=True) if text(i) != text(j)]
        if not clash:
            return order, again
        run, turn = (~again).cumsum(), turn + 1
        rows = order[np.isin(run, run[clash])]
        same[rows, 1] = [zlib.crc32(text(i), turn) for i in rows.tolist()]


def _spans(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2).cast(pa.large_binary()).fill_null(b"")
            text = pa.concat_arrays([text])
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if not len(text) or text.buffers()[2] is None:
                continue
            raw = np.frombuffer(text.buffers()[2], np.uint8)
            found, at_raw = [], []
            for lo, hi, start in _pieces(offsets, length):
                stop = min(offsets[hi], start + PIECE + length - 1) if hi == lo + 1 else offsets[hi]
                data = raw[start:stop]
                ends = np.minimum(offsets[lo + 1 : hi + 1], stop) - start
                first, count, at, anchor = anchored_spans(data, ends, length, gram)
                if not len(first):
                    continue
                view, last = data.tobytes(), first + count - 1 + length
                same = np.frombuffer(b"".join([_DIGEST(view[s:e]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]), np.uint64).reshape(-1, 2).copy()
                same[:, 0] = _mixed(same[:, 0] ^ (at - first).astype(np.uint64))
                at_raw.append(np.stack([first, last], 1) + start)
                row = lo + np.searchsorted(offsets[lo + 1 : hi + 1], first + start, side="right")
                found.append((anchor, same, row, (first + start - offsets[row]) << 16 | (count - 1) << 8 | (at - first)))
            if not found:
                continue
            anchor, same, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            bounds = np.concatenate(at_raw)
            order, again = _copies(anchor, same, lambda i, raw=raw, bounds=bounds: raw[bounds[i, 0] : bounds[i, 1]].tobytes())  # copies within the batch: one stands for them, the others are told and dealt anywhere
            kind = np.zeros(len(order), np.int32)
            kind[order] = np.where(again, 1, np.where(np.r_[again[1:], False], 4, 0))
            deal = np.where(kind == 1, _mixed(anchor ^ place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ row.astype(np.uint64) << np.uint64(20)), anchor)
            pick = pa.array(row)
            cols = [pa.array(deal.view(np.int64)), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in same.T], b.column(0).take(pick), b.column(1).take(pick), pa.array(place), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "same", "other", "doc_id", "hash", "place", "kind"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans to verdicts: 1 repeats in full; 2 and 3 stand for their kind in a mixed group, 3 if the only one."""

    def begins(t: pa.Table) -> np.ndarray:
        a, s, o = (t.column(c).to_numpy() for c in ("anchor", "same", "other"))
        return np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (o[1:] != o[:-1])]

    def verdicts(t: pa.Table, told: np.ndarray, before, after) -> pa.RecordBatch:
        """t: whole runs of equal spans. before, after: anchors of the runs next to it."""
        a, new = t.column("anchor").to_numpy(), begins(t)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(a)])
        many = (size > 1) | np.logical_or.reduceat(t.column("kind").to_numpy() == 4, first)
        heads = a[first]
        mixed = np.r_[heads[0] == before if before is not None else False, heads[1:] == heads[:-1]] | np.r_[heads[:-1] == heads[1:], heads[-1] == after if after is not None else False]
        full = np.flatnonzero(np.repeat(many, size) & ~told)
        rep, lone = first[mixed], ~many[mixed]
        pick = np.r_[full, rep]
        kind = np.r_[np.ones(len(full), np.int32), np.where(lone, 3, 2).astype(np.int32)]
        out = t.take(pa.array(pick)).combine_chunks()
        cols = [out.column(c).combine_chunks() for c in ("anchor", "doc_id", "hash", "place")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(kind)], ["anchor", "doc_id", "hash", "place", "kind"])

    def as_told(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).combine_chunks() for c in ("anchor", "doc_id", "hash", "place")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.ones(t.num_rows, np.int32))], ["anchor", "doc_id", "hash", "place", "kind"])

    held, told, before = None, np.zeros(0, bool), None
    for b in batches:
        t = pa.Table.from_batches([b])
        known = t.column("kind").to_numpy() == 1
        if known.any():
            yield as_told(t.filter(pa.array(known)).combine_chunks())
            t = t.filter(pa.array(~known))
        if not t.num_rows:
            continue
        if held is not None:
            t = pa.concat_tables([held, t])
        told = np.r_[told, np.zeros(t.num_rows - len(told), bool)]
        a = t.column("anchor").to_numpy()
        cut = int(np.flatnonzero(begins(t))[-1])
        if cut:
            yield verdicts(t.slice(0, cut), told[:cut], before, a[cut])
            before = a[cut - 1]
        held, told = t.slice(cut), told[cut:]
        if held.num_rows > 2:  # the open run is known to repeat: tell its rows, keep two that stand for it
            yield as_told(held.filter(pa.array(~told)).combine_chunks())
            held, told = held.slice(0, 2).combine_chunks(), np.ones(2, bool)
    if held is not None:
        yield verdicts(held, told, before, None)


def repeats_in_group(spans: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For spans (bytes, strings, anchor place) of one anchor: byte ranges of each that repeat in another of them."""
    n = len(spans)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right = Suffixes(b"".join(s for s, _, _ in spans))
    left = Suffixes(b"".join(s[:off][::-1] for s, _, off in spans))
    after, before, i, j = [], [], 0, 0
    for s, _, off in spans:
        after.append((i + off, i + len(s)))
        before.append((j, j + off))
        i, j = i + len(s), j + off

    def meet(x: int, y: int, ahead: int, back: int) -> None:
        for k in (x, y):
            _, count, off = spans[k]
            least, most = max(length - ahead, off - count + 1), min(back, off)  # bytes of a string before the anchor
            if least <= most:
                found[k].append((off - most, off - least + length))

    if n == 2:
        meet(0, 1, right.extension(*after[0], *after[1]), left.extension(*before[0], *before[1]))
        return found
    order, ahead = right.sorted_with_extensions(after)
    by_left, back = left.sorted_with_extensions(before)
    rank = [0] * n
    for r, k in enumerate(by_left):
        rank[k] = r
    sets: list[list[int]] = [[rank[k]] for k in order]
    at = list(range(n))  # union of neighbouring places of the suffix order

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    levels = [np.array(back)]  # minima over 1, 2, 4 ... neighbours
    while 2 << len(levels) - 1 < n:
        half, low = 1 << len(levels) - 1, levels[-1]
        levels.append(np.minimum(low[:-half], low[half:]))
    levels = [x.tolist() for x in levels]

    def between(a: int, b: int) -> int:
        """Common prefix, backwards, of the spans of ranks a < b."""
        j = (b - a).bit_length() - 1
        return min(levels[j][a], levels[j][b - (1 << j)])

    for e, k in sorted(((e, k) for k, e in enumerate(ahead)), key=lambda p: -p[0]):
        a, b = root(k), root(k + 1)
        if len(sets[a]) > len(sets[b]):
            a, b = b, a
        small, big = sets[a], sets[b]
        for r in small:
            i = bisect_left(big, r)
            if i:
                meet(by_left[r], by_left[big[i - 1]], e, between(big[i - 1], r))
            if i < len(big):
                meet(by_left[r], by_left[big[i]], e, between(r, big[i]))
        if len(small) < 8:
            for r in small:
                insort(big, r)
        else:
            big += small
            big.sort()
        sets[a] = []
        at[a] = b
    return found


def _sorter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(group: list[tuple]) -> list[tuple]:
            if len(group) < 2:
                return []
            spans = [(g[5], (g[3] >> 8 & 255) + 1, g[3] & 255) for g in group]
            return [(g[1], g[2], (g[3] >> 16) + a, (g[3] >> 16) + z) for g, got in zip(group, repeats_in_group(spans, length), strict=True) if g[4] == 3 for a, z in got]

        group: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != r[0]:
                    out += ranges(group)
                    group = []
                group.append(r)
            yield _ranges(out, b.schema.field(1).type)
        if group:
            yield _ranges(ranges(group), pa.int64() if not isinstance(group[0][1], str) else pa.string())

    return run


def _ranges(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "hash", "start", "stop"])


def _parted(length: int, gram: int, seed: int):
    """Rows of `spans` to their parts under a second anchor: both anchors mixed, place and bytes of the part."""

    def parts_of(b: pa.RecordBatch) -> pa.RecordBatch:
        raws = b.column(5).to_pylist()
        data = b"".join(raws)
        ends = np.cumsum([len(x) for x in raws])
        first, count, at, anchor = anchored_spans(np.frombuffer(data, np.uint8), ends, length, gram, seed)
        row = np.searchsorted(ends, first, side="right")
        start = b.column(3).to_numpy() >> 16
        place = (start[row] + first - np.r_[0, ends[:-1]][row]) << 16 | (count - 1) << 8 | (at - first)
        mixed = _mixed(b.column(0).to_numpy().view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) ^ anchor)
        parts = [data[s:e] for s, e in zip(first.tolist(), (first + count - 1 + length).tolist(), strict=True)]
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), b.column(1).take(pick), b.column(2).take(pick), pa.array(place), b.column(4).take(pick), pa.array(parts, pa.binary())], ["anchor", "doc_id", "hash", "place", "kind", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at_byte = np.r_[0, pc.binary_length(b.column(5)).to_numpy().cumsum()]
            for lo, hi, _ in _pieces(at_byte, length):  # a span has at most 2 * length - gram bytes
                yield parts_of(b.slice(lo, hi - lo))

    return run


def _range(start, count, length: int) -> list:
    return ["doc_id", "hash", start.alias("start"), (start + count - 1 + length).alias("stop")]


def repeated_ranges(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """doc_id, hash of the text, start, stop: byte ranges that cover every repeated string of `length` bytes (they overlap)."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    spans = docs.mapInArrow(_spans(length, gram), f"anchor long, same long, other long, doc_id {id_type}, hash long, place long, kind int")
    spans = spans.repartition(parts, "anchor").sortWithinPartitions("anchor", "same", "other")
    judged = written(spans.mapInArrow(_judge, f"anchor long, doc_id {id_type}, hash long, place long, kind int"), "judged")

    start, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)) + 1
    out = judged.where("kind = 1").select(*_range(start, count, length))
    ask = judged.where("kind > 1").withColumnRenamed("doc_id", "ask_id").withColumnRenamed("hash", "ask_hash")
    texts = docs.select("doc_id", "hash", F.col("text").cast("binary").alias("raw"))
    got = texts.join(ask, F.col("doc_id").eqNullSafe(F.col("ask_id")) & (F.col("hash") == F.col("ask_hash")))
    bytes_ = F.expr(f"substring(raw, int(shiftright(place, 16)) + 1, int((shiftright(place, 8) & 255) + {length}))")
    columns, schema = ("anchor", "doc_id", "hash", "place", "kind", "bytes"), f"anchor long, doc_id {id_type}, hash long, place long, kind int, bytes binary"
    got = written(got.select("anchor", "doc_id", "hash", "place", "kind", bytes_.alias("bytes")), "spans")

    for level in range(1, levels + 2):
        hot = written(got.groupBy("anchor").count().where(F.col("count") > group).select("anchor"), "hot")
        none = hot.isEmpty()
        usual = got if none else got.join(hot, "anchor", "left_anti")
        usual = usual.repartition(parts, "anchor").sortWithinPartitions("anchor")
        out = out.union(usual.mapInArrow(_sorter(length), f"doc_id {id_type}, hash long, start long, stop long"))
        if none:
            return out
        rest = got.join(hot, "anchor", "left_semi").select(*columns)
        if level > levels:
            break
        cut = written(rest.mapInArrow(_parted(length, gram, 0x2545F4914F6CDD1D * level % (1 << 64)), schema), "parts")
        key = ["anchor", "bytes", F.col("place").bitwiseAND(F.lit(255)).alias("off")]
        kinds = written(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "hash", "place")).alias("r"), F.max(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("two")), "kinds")
        many = kinds.where("n > 1 or two = 1").select("anchor", "bytes", "off")
        out = out.union(cut.where("kind = 3").withColumn("off", F.col("place").bitwiseAND(F.lit(255))).join(many, ["anchor", "bytes", "off"], "left_semi").select(*_range(start, count, length)))
        got = kinds.select("anchor", "r.*", F.when((F.col("n") > 1) | (F.col("two") == 1), 2).otherwise(3).alias("kind"), "bytes").select(*columns)
        got = written(got, "spans")
    string = F.explode(F.expr("sequence(0, int(shiftright(place, 8) & 255))"))
    each = rest.select("*", string.alias("i")).withColumn("string", F.expr(f"substring(bytes, i + 1, {length})"))
    often = each.groupBy("anchor", "string").count().where("count > 1").select("anchor", "string")
    first = F.shiftright("place", 16) + F.col("i")
    return out.union(each.where("kind = 3").join(often, ["anchor", "string"], "left_semi").select("doc_id", "hash", first.alias("start"), (first + length).alias("stop")))


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted (start, stop) rows joined where they overlap or touch."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.r_[True, r[1:, 0] > reach[:-1]]
    return np.stack([r[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]]], 1)


def with_ranges(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with one column more, the last: their repeated ranges as a flat array (start, stop, start, stop ...), null where there are none."""
    ranges, own, mark = (fresh(documents, c) for c in ("ranges", "own_id", "own_hash"))
    found = repeated_ranges(documents, length)
    flat = F.flatten(F.collect_list(F.array("start", "stop"))).alias(ranges)
    found = found.groupBy(F.col("doc_id").alias(own), F.col("hash").alias(mark)).agg(flat)
    key = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark))
    return documents.join(found, key, "left").drop(own, mark)


def _ranges_of(flat) -> np.ndarray:
    return merged(np.array([] if flat is None else flat, np.int64).reshape(-1, 2))


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw, flat in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2), strict=True):
            raw = raw or b""
            spans = _ranges_of(flat.values.to_numpy() if flat.is_valid else None)
            rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op2_suffix_dedup(documents: DataFrame) -> DataFrame:
    found = with_ranges(documents.select("doc_id", "text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """The ranges without the bytes of characters that they cover in part."""
    out = []
    for a, z in spans.tolist():
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return np.array(out, np.int64).reshape(-1, 2)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, names = [], b.schema.names
        for raw, flat in zip(b.column(names.index("text")).cast(pa.binary()).to_pylist(), b.column(len(names) - 1), strict=True):
            if raw is None or not flat.is_valid:
                t.append(raw)
            else:
                t.append(kept_bytes(raw, whole_characters(raw, _ranges_of(flat.values.to_numpy()))))
        text = pa.array(t, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([text if n == "text" else b.column(k) for k, n in enumerate(names[:-1])], names[:-1])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with the repeated strings taken out of `text`, whole characters only; all other columns stay."""
    return with_ranges(documents, length).mapInArrow(_cleaned, documents.schema)


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
x as (select r, doc_id, hex(b) as h, octet_length(b) as n from d),
p as (select r, p, substr(h, p * 512 + 1, 512 + 400) as part from x, lateral (select unnest(range(0, (2 * n + 511) // 512)) as p)),
s as (select r, p * 256 + k as k, md5(substr(part, 2 * k + 1, 400)) as m from p, lateral (select unnest(range(0, least(256, len(part) // 2 - 199))) as k)),
m as (select m from s group by m having count(*) > 1),
q as (select r, k from s semi join m using (m)),
g as (select r, k, case when k - lag(k) over (partition by r order by k) <= 200 then 0 else 1 end as new from q),
i as (select r, k, sum(new) over (partition by r order by k rows unbounded preceding) as g from g),
t as (select r, min(k) as a, max(k) + 200 as z from i group by r, g),
u as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as last from t),
k as (select r, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as front, max(z) as z, sum(z - a) as removed, count(*) as spans from u join x using (r) group by r)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(z, 0) + 1))) as kept_sha256 from x left join k using (r)
"""
