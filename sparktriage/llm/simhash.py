"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside agreeing buckets, connected components.

Two fingerprints that differ in at most r bits agree on all but r of any division of the 64 bits, so with r + 2 blocks
they agree on two blocks at least. Distinct fingerprints meet in a bucket per pair of blocks; copies of a text never
meet each other. Buckets beyond BLOCK rows are compared as pairs of sub-blocks, one task row set each, so that no bucket
is collected whole. Inside a unit the bits stand in vertical planes, carry-save counters add up the differing planes of
64 lanes a word, and a block of lanes is abandoned once every lane is past the radius.

Defined results: null or empty text has fingerprint zero and links as any other; a repeated doc_id gives a row for each of
its rows; a null doc_id never names a component unless no other id is in it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_first, written
from .components import connected_components

BLOCK = 4096
LANES = 1 << 16
_HASH = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's shingles with repeats: lower-cased A-Z words between ASCII blanks, `width` words each."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = size.cumsum() - size
    n = max(1, len(words) - width + 1)
    end = (start + size - 1)[min(width, len(words)) - 1 :]
    return np.fromiter([_HASH(joined[s:e], 42) for s, e in zip(start[:n].tolist(), end.tolist(), strict=True)], np.uint64, n)


def fingerprint_of(h: np.ndarray) -> int:
    """SimHash of a text's shingle hashes, repeats included."""
    if not (n := len(h)):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of one text over its shingles of `width` words."""
    return fingerprint_of(shingle_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x) for x in b.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "hash", "fp"])


def planes(x: np.ndarray) -> np.ndarray:
    """uint64 values to 64 vertical planes of packed lanes; lanes are padded to whole words with zeros."""
    lanes = -(-len(x) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(x)] = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_lanes(diff, shape, radius: int) -> np.ndarray | None:
    """Words whose bits mark lanes with at most radius differing planes; None if the block was abandoned.

    diff(p) gives plane p of the differences. The counters are bit-sliced: bit k of every lane's count stands in count[k].
    """
    count = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    past = np.zeros(shape, np.uint64)
    every = ~np.uint64(0)

    def beyond():
        over, same = past.copy(), np.full(shape, every)
        for k in reversed(range(len(count))):
            if not radius >> k & 1:
                over |= same & count[k]
            same &= count[k] if radius >> k & 1 else ~count[k]
        return over

    for p in range(64):
        carry = diff(p)
        for c in count:
            carry, c[...] = c & carry, c ^ carry
        past |= carry
        if p % 8 == 7 and p < 63 and (beyond() == every).all():
            return None
    return ~beyond()


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


class Labels:
    """Least-index labels under union of many pairs at once."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.to[u], self.to[v]
            if not (apart := a != b).any():
                return
            np.minimum.at(self.to, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.to != (up := self.to[self.to])).any():
                self.to = up


def link_units(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each unit's components. unit: ascending unit numbers; side: 0 left, 1 right, 2 both.

    Small units of a batch are compared side by side, lane i with lane i + s for each shift s; large ones row against
    planes.
    """
    n = len(fp)
    lab = Labels(n)
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    meets = lambda i, j: (side[i] == 2) | (side[i] != side[j])
    small = np.repeat(size <= 64, size)
    left = np.repeat(first + size, size) - np.arange(n)
    at, s = np.flatnonzero(small & (left > 1)), 1
    while len(at):
        for k in range(0, len(at), LANES):
            i = at[k : k + LANES]
            i = i[meets(i, i + s)]
            d = planes(fp[i] ^ fp[i + s])
            if (near := close_lanes(d.__getitem__, d.shape[1], radius)) is not None:
                i = i[_lanes(near)[: len(i)]]
                lab.join(i, i + s)
        s += 1
        at = at[left[at] > s]
    for f, m in zip(first[size > 64], size[size > 64], strict=True):
        own = fp[f : f + m]
        wall = planes(own)
        rows = np.flatnonzero(side[f : f + m] != 1)
        for k in range(0, len(rows), 32):
            q = rows[k : k + 32]
            bit = ((own[q][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
            near = close_lanes(lambda p, b=bit, w=wall: np.where(b[:, p, None], ~w[p], w[p]), (len(q), wall.shape[1]), radius)
            if near is not None:
                x, y = np.nonzero(_lanes(near).reshape(len(q), -1)[:, :m])
                keep = (q[x] != y) & meets(f + q[x], f + y)
                lab.join(f + q[x][keep], f + y[keep])
    moved = np.flatnonzero(lab.to != np.arange(n))
    return moved, lab.to[moved]


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the unit that is still open

        def links(rows):
            fp = rows[:, 5].astype(np.int64).view(np.uint64)
            same = (rows[1:, :4] == rows[:-1, :4]).all(1)
            unit = np.r_[0, (~same).cumsum()]
            lo, hi, mine = rows[:, 2], rows[:, 3], rows[:, 4]
            u, v = link_units(fp, unit, np.where(lo == hi, 2, np.where(mine == lo, 0, 1)), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[u].view(np.int64)), pa.array(fp[v].view(np.int64))], ["a", "b"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            ends = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
            if len(held) > 1 and not (held[-2][-1, :4] == rows[0, :4]).all():
                ends = np.r_[-1, ends]
            if len(ends):
                cut = ends[-1] + 1
                done = np.concatenate([*held[:-1], rows[:cut]])
                held = [rows[cut:]]
                if len(done):
                    yield links(done)
        if held:
            yield links(np.concatenate(held))

    return run


def candidate_units(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints to units (combo, key, lo, hi) with the row's own sub-block, as the comparer takes them."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    field = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    combos = [F.struct(F.lit(k).alias("combo"), F.shiftleft(field[i], cuts[j + 1] - cuts[j]).bitwiseOR(field[j]).alias("key")) for k, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    rows = fps.select("fp", F.explode(F.array(*combos)).alias("c")).select("c.combo", "c.key", "fp")
    size = rows.groupBy("combo", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(block)).cast("int")
    met = rows.join(size, ["combo", "key"]).withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("combo", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp")


def fingerprint_links(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp: long) to links (a, b) that span the components of those which differ in at most radius bits."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = candidate_units(fps, radius, block)
    units = units.repartition(n, "combo", "key", "lo", "hi").sortWithinPartitions("combo", "key", "lo", "hi")
    return units.mapInArrow(_linker(radius), "a long, b long")


def near_components(documents: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, hash of the text, fp (long), root (a fingerprint that names the component), component_id of every document row."""
    schema = documents.select("doc_id").schema.add("hash", "long").add("fp", "long")
    docs = written(documents.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(_fingerprints, schema), "fingerprints")
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius, block))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select("doc_id", "hash", "fp", "root", "component_id")


def keep_representatives(documents: DataFrame, radius: int = 2) -> DataFrame:
    """One document row of each component, with all its columns."""
    return keep_first(documents, near_components(documents, radius))


def op8_simhash(documents: DataFrame) -> DataFrame:
    found = near_components(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
