"""Near copies by SimHash and exact Jaccard similarity of word shingles: candidates by fingerprint and by prefix, checked sets, connected components.

Fingerprints of the shingles, compared bit-sliced in buckets as in simhash, propose the close pairs: at most RADIUS differing bits.
Similar texts differ in up to 11 bits, and buckets for such a radius hold too many rows, so the prefixes below add every pair that is further
apart. A proposed pair whose parity maps differ too much is dropped, and whole sets decide on all candidates alike.

Texts of equal words are one node. In any one order of all shingles, two sets of similarity s share one of the first
n - ceil(s n) + 1 of each, so only those are dealt out, and nodes that meet in no bucket have no partner. The order puts
shingles that are common in a sample of the documents last; the sample only chooses among orders that all find every pair.
Buckets with the same nodes are compared once, by parity maps: each shingle flips one of the map's bits, so two maps differ in no
more bits than their sets in shingles, and no similar pair is lost. A map has two bits a shingle or more, so that maps of
long texts tell them apart too; maps of two sizes are compared after folding the larger. What the maps link makes groups; the texts of a group
come together once and are linked by their whole sets. Buckets and groups beyond BLOCK nodes, and groups of more than HELD
shingles together, are compared as pairs of sub-blocks. Only nodes that are not linked yet are compared, so a large group gives few links.

Defined results: words are as in simhash, a text under `width` words is one shingle, texts without words are one node;
shingles and nodes stand as 64-bit hashes; a group keeps the row of its smallest doc_id (null after all others), then of
the smallest hash of the text, then one of the rows that are equal in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, keep_first, labelled_sample, written
from .components import connected_components
from .simhash import fingerprint_links, fingerprint_of, shingle_hashes

WIDTH, SIMILAR, RADIUS = 5, (4, 5), 3
BLOCK, BITS = 2048, 1024
HELD = 1_000_000  # shingles of a sub-block that is compared by whole sets
SAMPLE, OFTEN, COMMON = 5_000, 4, 50_000
MOST_LISTED = 1_000_000
_HASH = xxhash.xxh3_64_intdigest


def _joined(raw: bytes | None) -> bytes:
    return b" ".join((raw or b"").lower().split())


def prefix(s: np.ndarray, common: np.ndarray, weight: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set (ascending) in the order of weight, then hash: one of them is in any similar set's prefix."""
    num, den = similar
    k = len(s) - -(-num * len(s) // den) + 1
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        known = common[at] == s
        if known.any():
            return s[np.argsort(np.where(known, weight[at], 0), kind="stable")[:k]]
    return s[:k]


def parity(s: np.ndarray) -> bytes:
    """A map of at least two bits a shingle, BITS at least; folding its upper half onto the lower gives the map of half the size."""
    bits = max(BITS, 1 << max(0, 2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(11)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, width)) for x in b.column(0).cast(pa.binary()).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    return run


def _sketches(width: int, similar: tuple[int, int], common: np.ndarray, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [_joined(x) for x in b.column(2).cast(pa.binary()).to_pylist()]
            if not raws:
                continue
            node = np.array([_HASH(x) for x in raws], np.uint64).view(np.int64)
            hashes = [shingle_hashes(x, width) for x in raws]
            fp = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            firsts = [prefix(x, common, weight, similar) for x in sets]
            off = np.r_[0, np.cumsum([len(x) for x in firsts])].astype(np.int32)
            maps = pa.array([parity(x) for x in sets], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(firsts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), maps, lists], ["doc_id", "hash", "node", "fp", "n", "parity", "prefix"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle to those that share it with another, with size and two digests of the bucket's nodes."""
    odd = np.uint64(0x9E3779B97F4A7C15)

    def found(h, node):
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        x = node.view(np.uint64) * odd
        x ^= x >> np.uint64(29)
        cols = [np.repeat(c, size) for c in (size, np.bitwise_xor.reduceat(x, first).view(np.int64), np.add.reduceat(x * odd, first).view(np.int64))]
        many = cols[0] > 1
        return pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (h, node, *cols)], ["h", "node", "size", "x", "s"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for b in batches:
        h, node = (np.concatenate([a, c.to_numpy()]) for a, c in zip(held, b.columns, strict=True))
        if not len(h):
            continue
        cut = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
        held = (h[cut:], node[cut:])
        if cut:
            yield found(h[:cut], node[:cut])
    if len(held[0]):
        yield found(*held)


def _links(size: np.ndarray, side: np.ndarray, similar: tuple[int, int], near) -> list[tuple[int, int]]:
    """Links that span the components of near pairs. size: ascending; side: 0 left, 1 right, 2 both; near(i, j): marks of places j."""
    num, den = similar
    label, links = np.arange(len(size)), []
    for i in range(len(size) - 1):
        j = np.arange(i + 1, int(np.searchsorted(size, size[i] * den // num, side="right")))
        j = j[(label[j] != label[i]) & ((side[j] == 2) | (side[j] != side[i]))]
        if not len(j):
            continue
        for k in j[near(i, j)].tolist():
            if label[k] != label[i]:
                links.append((i, k))
                label[label == label[k]] = label[i]
    return links


def link_sets(sets: list[np.ndarray], side: np.ndarray, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (places in `sets`) that span the components of similar sets."""
    num, den = similar
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    own = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].ravel()
    off = size.cumsum() - size
    mark = np.zeros(int(own.max()) + 1, bool)

    def near(i, j):
        mine = own[off[i] : off[i] + size[i]]
        mark[mine] = True
        n = size[j]
        start = n.cumsum() - n
        both = np.add.reduceat(mark[own[np.repeat(off[j] - start, n) + np.arange(int(n.sum()))]], start, dtype=np.int64)
        mark[mine] = False
        return den * both >= num * (size[i] + n - both)

    return [(int(order[i]), int(order[k])) for i, k in _links(size, side[order], similar, near)]


def link_maps(sizes: list[int], maps: list[bytes], side: np.ndarray, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that span the components of sets which may be similar by their parity maps; of two sizes the larger map is folded."""
    num, den = similar
    order = np.argsort(sizes, kind="stable")
    size = np.array(sizes, np.int64)[order]
    wide = np.array([len(maps[i]) for i in order])
    held, begin = {}, {}
    for w in np.unique(wide).tolist():  # ascending sizes have ascending maps
        rows = np.flatnonzero(wide == w)
        begin[w] = int(rows[0])
        held[w, w] = np.frombuffer(b"".join([maps[order[r]] for r in rows]), np.uint64).reshape(len(rows), -1)

    def folded(w: int, to: int) -> np.ndarray:
        if (w, to) not in held:
            x = folded(w, 2 * to)
            held[w, to] = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return held[w, to]

    def near(i, j):
        own, out = int(wide[i]), np.zeros(len(j), bool)
        mine = held[own, own][i - begin[own]]
        for w in np.unique(wide[j]).tolist():
            at = np.flatnonzero(wide[j] == w)
            apart = np.bitwise_count(folded(w, own)[j[at] - begin[w]] ^ mine).sum(1, dtype=np.int64)
            out[at] = (den + num) * apart <= (den - num) * (size[i] + size[j[at]])
        return out

    return [(int(order[i]), int(order[k])) for i, k in _links(size, side[order], similar, near)]


def _linker(link, own=None):
    """Rows sorted by unit, sub-blocks (lo, hi) to links; link(values, side): the links of one unit. A row's values are what
    follows its node; own(*values) stands for them, where given, as soon as the row is read."""

    def rows(batches):
        for b in batches:
            head, values = ([b.column(k).to_pylist() for k in ks] for ks in (range(5), range(5, b.num_columns)))
            yield from zip(*head, *([map(own, *values)] if own else values), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, z = [], []
        for (_, lo, hi), unit in groupby(rows(batches), lambda r: r[:3]):
            unit = list(unit)
            if len(unit) < 2:
                continue
            side = np.array([2 if lo == hi else int(r[3] != lo) for r in unit])
            for i, k in link([r[5:] for r in unit], side):
                a.append(unit[i][4])
                z.append(unit[k][4])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])
                a, z = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def _near_pairs(similar: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.array([2, 2])
        for b in batches:
            na, xa, nb, xb = (b.column(k).to_pylist() for k in range(2, 6))
            near = [bool(link_maps([m, n], [x, y], both, similar)) for m, x, n, y in zip(na, xa, nb, xb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def proposed_pairs(sketch: DataFrame, maps: DataFrame, radius: int = RADIUS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links (a, b) of nodes that span the components of close fingerprints, less those that parity maps (node, n, parity) rule out."""
    classes = written(sketch.groupBy("fp").agg(F.min("node").alias("rep")), "classes")
    same = sketch.join(classes, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    end = lambda c: classes.select(F.col("fp").alias(c), F.col("rep").alias(f"node_{c}"))
    near = fingerprint_links(classes.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select("node_a", "node_b")
    about = lambda c: maps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    pairs = near.union(same).toDF("a", "b").distinct().join(about("a"), "a").join(about("b"), "b")
    return pairs.select("a", "b", "n_a", "parity_a", "n_b", "parity_b").mapInArrow(_near_pairs(similar), "a long, b long")


def _dealt(met: DataFrame, about: DataFrame) -> DataFrame:
    """met(h, node, parts) with the columns that `about` has by node, dealt and sorted by unit and pair of sub-blocks."""
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = met.join(about, "node").withColumn("mine", F.pmod(F.xxhash64("node", "h"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = [c for c in about.columns if c != "node"]
    units = units.select("h", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", *own)
    return units.repartition(parts, "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")


def _common(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and how often: only the order of shingles depends on them."""
    sample = labelled_sample(documents.select("doc_id", "text"), SAMPLE, "shingles")
    often = sample.select("text").mapInArrow(_shingles(width), "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    top = often.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in top], np.int64)[order]


def similar_components(documents: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, block: int = BLOCK, held: int = HELD, radius: int = RADIUS) -> DataFrame:
    """doc_id, hash of the text, node, root of every document row: rows of one root are linked by similar pairs."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    run = _sketches(width, similar, *_common(documents, width))
    sketch = written(docs.mapInArrow(run, f"doc_id {id_type}, hash long, node long, fp long, n int, parity binary, prefix array<long>"), "sketches")
    rows = sketch.groupBy("node").agg(F.first("prefix").alias("prefix")).select(F.explode("prefix").alias("h"), "node")
    met = rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_buckets, "h long, node long, size long, x long, s long")
    met = written(met, "buckets")
    once = met.groupBy("size", "x", "s").agg(F.min("h").alias("h")).select("h")
    met = met.join(once, "h", "left_semi").select("h", "node", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("parts"))
    maps = sketch.groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    by_map = _linker(lambda unit, side: link_maps([r[0] for r in unit], [r[1] for r in unit], side, similar))
    close = proposed_pairs(sketch, maps, radius, similar)
    groups = written(connected_components(_dealt(met, maps).mapInArrow(by_map, "a long, b long").union(close)), "groups")

    parts_of = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n") / F.lit(held))).cast("int")
    named = groups.join(groups.join(maps.select("node", "n"), "node").groupBy("root").agg(parts_of.alias("parts")), "root").select(F.col("root").alias("h"), "node", "parts")
    one = sketch.join(named.select("node"), "node").groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("r"))
    one = written(one.select("node", F.col("r.doc_id").alias("__id"), F.col("r.hash").alias("__hash")), "listed")
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    texts = docs.join(broadcast_if(one, one.count(), MOST_LISTED), key).select("node", F.col("text").cast("binary").alias("raw")).dropDuplicates(["node"])
    by_set = _linker(lambda unit, side: link_sets([r[0] for r in unit], side, similar), lambda raw: np.unique(shingle_hashes(raw, width)))
    roots = connected_components(_dealt(named, texts).mapInArrow(by_set, "a long, b long")).withColumnRenamed("node", "__node")
    named = sketch.join(roots, sketch.node == F.col("__node"), "left")
    return named.select("doc_id", "hash", "node", F.coalesce("root", "node").alias("root"))


def keep_dissimilar(documents: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One document row of each group of linked texts, with all its columns."""
    return keep_first(documents, similar_components(documents, width, similar))
