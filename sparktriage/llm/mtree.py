"""Exact top-k by inner product: M-trees with paged nodes, searched best-first.

Inner products become a metric by one more coordinate: x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
d(q', x')^2 = |q|^2 + M^2 - 2 q.x, M the longest vector of the table. A bounded number of pivots, rows of the table, part it
into cells by nearness; a cell with more rows than a shard may have is cut by a hash of the rows' places, so equal rows part
as well. Each shard is bulk-loaded into a tree whose pages store for every entry its distance to the page's own routing object
(a stored row), and for every child its covering radius. A search takes nodes in order of their lower bound; the stored parent
distances rule entries out by the triangle inequality before any distance is computed. It ends when the nearest node left
is farther than the k-th best. A query searches one shard of its nearest cell first; its k-th score there then rules out
whole cells by their radii, and is what the search of every other shard starts from. Bounds are widened by a float
tolerance, scores are exact integers. Queries come in blocks, so a task holds one tree and one block; each gives k rows a
query at most, which are merged.

Defined results: vectors null or with null or non-finite components are left out; vectors meet those of their own dimension
only; rows with the query's id are never its candidates; repeated rows are candidates of their own, a repeated query counts
once; fewer candidates than k give all of them; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD = 16_384
QUERIES = 4096
PIVOTS = 256
PAGE = 96
FANOUT = 12
SLACK = 1e-7


@dataclass
class Node:
    """One page. Entries: rows of a leaf, or children. apart: distance of each entry's object to this page's routing object."""

    center: np.ndarray
    radius: float
    apart: np.ndarray
    rows: np.ndarray | None = None
    children: list | None = None
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None


class MTree:
    """Tree over integer vectors (as float64, exact below 2^53); lift holds the added coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        """top: the largest squared norm of all shards."""
        self.ids, self.vectors, self.top = ids, vectors, top
        norm = (vectors.astype(np.float64) ** 2).sum(1)
        self.points = np.c_[vectors.astype(np.float64), np.sqrt(np.maximum(self.top - norm, 0))]
        self.root = self._load(np.arange(len(ids)), self.points[0] if len(ids) else np.zeros(1)) if len(ids) else None

    def _to(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - center) ** 2).sum(1))

    def _object(self, rows: np.ndarray) -> np.ndarray:
        """The routing object of some rows: the stored one nearest to their mean."""
        return self.points[rows[self._to(rows, self.points[rows].mean(0)).argmin()]]

    def _load(self, rows: np.ndarray, center: np.ndarray) -> Node:
        apart = self._to(rows, center)
        radius = float(apart.max())
        if len(rows) <= PAGE:
            order = np.argsort(self.ids[rows], kind="stable")
            return Node(center, radius, apart[order], rows=rows[order])
        k = min(FANOUT, -(-len(rows) // (PAGE // 2)))
        pick, near, own = int(apart.argmax()), np.full(len(rows), np.inf), np.zeros(len(rows), int)
        for c in range(k):  # farthest-first routing objects
            d = self._to(rows, self.points[rows[pick]])
            own[d < near], near = c, np.minimum(d, near)
            pick = int(near.argmax())
        parts = [rows[own == c] for c in range(k) if (own == c).any()]
        if max(map(len, parts)) > 0.9 * len(rows):  # copies and outliers: cut evenly by distance
            parts = np.array_split(rows[np.argsort(apart, kind="stable")], k)
        made = [self._load(p, self._object(p)) for p in parts]
        centers = np.stack([m.center for m in made])
        return Node(center, radius, np.sqrt(((centers - center) ** 2).sum(1)), children=made, centers=centers, radii=np.array([m.radius for m in made]))

    def _visits(self, q: np.ndarray, reach: np.ndarray) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaves, and of each query and leaf that `reach` doesn't rule out: query, leaf, lower bound, distance to the leaf's routing object."""
        leaves, found = [], []
        every = np.arange(len(q))
        todo = [(self.root, every, np.sqrt(((q - self.root.center) ** 2).sum(1)))]
        while todo:
            node, own, d = todo.pop()
            if node.rows is not None:
                found.append((own, np.full(len(own), len(leaves)), np.maximum(d - node.radius, 0), d))
                leaves.append(node)
                continue
            near = np.abs(d[:, None] - node.apart) - node.radii <= reach[own][:, None]  # by the stored distances alone
            for c in np.flatnonzero(near.any(0)).tolist():
                at = own[near[:, c]]
                e = np.sqrt(((q[at] - node.centers[c]) ** 2).sum(1))
                on = e - node.radii[c] <= reach[at]
                if on.any():
                    todo.append((node.children[c], at[on], e[on]))
        found = found or [[np.zeros(0, t) for t in (int, int, float, float)]]
        return leaves, *(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query (its place), score, vec_id of the k best of each query, ties to the smaller id. least: a score that k other rows reach, or NaN; lower ones may be left out.

        Every query takes its pages best-first, in rounds of 1, 2, 4 ... pages; queries that want the same page in a round share its product.
        """
        x = queries.astype(np.float64)
        q, far = np.c_[x, np.zeros(len(x))], (x**2).sum(1) + self.top
        slack = SLACK * np.sqrt(1 + far)
        tau = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(far - 2 * np.nan_to_num(least), 0)))
        best = [np.zeros(0, np.int64)] * 3
        if self.root is None or not len(x):
            return tuple(best)
        leaves, asks, leaf, bound, apart = self._visits(q, tau + slack)
        order = np.lexsort((bound, asks))
        asks, leaf, bound, apart = (v[order] for v in (asks, leaf, bound, apart))
        place = np.arange(len(asks)) - np.searchsorted(asks, asks)
        kth, lo, step = np.full(len(x), np.iinfo(np.int64).min), 0, 1
        while lo <= place.max(initial=-1):
            due = np.flatnonzero((place >= lo) & (place < lo + step) & (bound <= (tau + slack)[asks]))
            due = due[np.argsort(leaf[due], kind="stable")]
            found = [best]
            for part in np.split(due, np.flatnonzero(np.diff(leaf[due])) + 1):
                if not len(part):
                    continue
                node, own = leaves[leaf[part[0]]], asks[part]
                may = np.abs(apart[part][:, None] - node.apart) <= (tau + slack)[own][:, None]
                cols = np.flatnonzero(may.any(0))
                rows = node.rows[cols]
                score = (queries[own] @ self.vectors[rows].T).astype(np.int64)
                i, j = np.nonzero(may[:, cols] & (score >= kth[own][:, None]) & (self.ids[rows] != query_ids[own][:, None]))
                found.append([own[i], score[i, j], self.ids[rows[j]]])
            who, score, ids = (np.concatenate(v) for v in zip(*found, strict=True))
            keep = np.lexsort((ids, -score, who))
            who, score, ids = who[keep], score[keep], ids[keep]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            best = [who[rank < k], score[rank < k], ids[rank < k]]
            full = rank == k - 1
            kth[who[full]] = score[full]
            tau[who[full]] = np.minimum(tau[who[full]], np.sqrt(np.maximum(far[who[full]] - 2.0 * score[full], 0)))
            lo, step = lo + step, step * 2
        return tuple(best)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    big = float(np.abs(x).max()) if x.size else 0.0
    return x.astype(np.float64) if big * big * dim < 2.0**52 else x  # float products are exact and fast below that


def _builder(tops: dict[int, float]):
    def run(t: pa.Table) -> pa.Table:
        dim, cell, sub = (t[c][0].as_py() for c in ("dim", "cell", "sub"))
        tree = MTree(t["vec_id"].to_numpy(), _matrix(t["v"], dim), tops[dim])
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "sub": pa.array([sub], pa.int32()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    return run


def _searcher(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        who = score = ids = names = np.zeros(0, np.int64)
        if len(trees) and len(queries):
            tree: MTree = pickle.loads(trees["tree"][0].as_py())
            q = _matrix(queries["v"], queries["dim"][0].as_py())
            if q.dtype != tree.vectors.dtype:
                q, tree.vectors = q.astype(np.int64), tree.vectors.astype(np.int64)
            names = queries["vec_id"].to_numpy()
            who, score, ids = tree.search(names, q, k, queries["least"].to_numpy(zero_copy_only=False).astype(np.float64))
        return pa.table([pa.array(c, pa.int64()) for c in (names[who], ids, score)], names=["query_id", "vec_id", "score"])

    return run


@dataclass
class Cells:
    """Pivots of the vectors of one dimension with their added coordinate; radius and number of shards of each cell."""

    top: float
    pivots: np.ndarray
    radius: np.ndarray | None = None
    shards: np.ndarray | None = None

    def of_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it; lifted vectors all have the squared norm `top`."""
        lift = np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        d = np.sqrt(np.maximum(2 * self.top - 2 * (x @ self.pivots[:, :-1].T + lift[:, None] * self.pivots[:, -1]), 0))
        own = d.argmin(1)
        return own, d[np.arange(len(x)), own]

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of the queries to all pivots."""
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.top - 2 * q @ self.pivots[:, :-1].T, 0))


def _by_dim(b: pa.RecordBatch, dim_at: int, v_at: int):
    """Rows and float matrix of each dimension of a batch."""
    dims = b.column(dim_at).to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, b.column(v_at).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _cells(vectors: DataFrame, shard: int, most: int) -> dict[int, Cells]:
    """Pivots by dimension: rows in order of a hash, as many as there are shards, but at most `most`. Dimensions are few."""
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    out = {}
    for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).collect():
        p = min(most, -(-r.n // shard))
        key = F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(1 << 40))
        few = vectors.where((F.col("dim") == r.dim) & (key <= F.lit(int((1 << 40) * min(1.0, 8 * p / r.n))))) if p > 1 else vectors.where(F.col("dim") == r.dim)
        rows = few.select("v").distinct().orderBy(F.xxhash64("v")).limit(p).collect() if p > 1 else few.select("v").limit(1).collect()
        x = np.array([q.v for q in rows], np.float64).reshape(-1, r.dim)
        x = x if len(x) else np.zeros((1, r.dim))
        out[r.dim] = Cells(r.top, np.c_[x, np.sqrt(np.maximum(r.top - (x**2).sum(1), 0))])
    return out


def _assigned(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, apart = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d, rows, x in _by_dim(b, 1, 2):
                own[rows], apart[rows] = cells[d].of_rows(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(apart)], ["vec_id", "dim", "v", "cell", "apart"])

    return run


def _routed(cells: dict[int, Cells], first: bool):
    """Queries (vec_id, dim, v, least) to the shards they search: first, shard 0 of the nearest cell; then every other that least can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = b.column(3).to_numpy(zero_copy_only=False)
            for d, rows, q in _by_dim(b, 1, 2):
                if d not in cells:
                    continue
                c = cells[d]
                apart = c.of_queries(q)
                near = np.where(c.shards > 0, apart, np.inf).argmin(1)
                if first:
                    i, cell, sub = np.arange(len(q)), near, np.zeros(len(q), np.int64)
                else:
                    far = (q**2).sum(1) + c.top
                    tau = np.sqrt(np.maximum(far - 2 * np.nan_to_num(least[rows], nan=-np.inf), 0))
                    i, cell = np.nonzero((apart - c.radius <= (tau + 2 * SLACK * np.sqrt(1 + far))[:, None]) & (c.shards > 0))
                    n = c.shards[cell]
                    i, cell, sub = np.repeat(i, n), np.repeat(cell, n), np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
                    other = (cell != near[i]) | (sub > 0)
                    i, cell, sub = i[other], cell[other], sub[other]
                for lo in range(0, len(i), 4096):
                    part = slice(lo, lo + 4096)
                    pick = b.take(pa.array(rows[i[part]]))
                    yield pa.RecordBatch.from_arrays([*pick.columns, pa.array(cell[part].astype(np.int32)), pa.array(sub[part].astype(np.int32))], ["vec_id", "dim", "v", "least", "cell", "sub"])

    return run


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, v: floor(256 x) of every component, for vectors whose components are all there and finite."""
    x = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.where(fine).select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * 256.0)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = QUERIES, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries` (both as quantised() gives)."""
    vectors, queries = written(vectors, "vectors"), written(queries.distinct(), "queries")
    cells = _cells(vectors, shard, pivots)
    dealt = written(vectors.mapInArrow(_assigned(cells), "vec_id long, dim int, v array<long>, cell int, apart double"), "dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
    for c in cells.values():
        c.radius, c.shards = np.zeros(len(c.pivots)), np.zeros(len(c.pivots), np.int64)
    for r in sizes.collect():  # `pivots` rows a dimension at most
        cells[r.dim].radius[r.cell], cells[r.dim].shards[r.cell] = r.radius, -(-r.n // shard)
    parts = F.greatest(F.ceil(F.col("n") / F.lit(shard)), F.lit(1))
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(sizes.select("dim", "cell", "n")), ["dim", "cell"])
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("place"), parts).cast("int")).select("dim", "cell", "sub", "vec_id", "v")
    trees = written(dealt.groupBy("dim", "cell", "sub").applyInArrow(_builder({d: c.top for d, c in cells.items()}), "dim int, cell int, sub int, tree binary"), "trees")
    blocks, key = max(1, -(-queries.count() // block)), ["dim", "cell", "sub", "block"]

    def search(asked: DataFrame, first: bool) -> DataFrame:
        right = asked.mapInArrow(_routed(cells, first), "vec_id long, dim int, v array<long>, least double, cell int, sub int")
        right = right.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        due = right.select(*[F.col(c).alias(f"due_{c}") for c in key]).distinct()
        same = (F.col("dim") == F.col("due_dim")) & (F.col("cell") == F.col("due_cell")) & (F.col("sub") == F.col("due_sub"))
        left = trees.join(due, same).select("dim", "cell", "sub", F.col("due_block").alias("block"), "tree")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")

    asked = queries.select("vec_id", "dim", "v")
    near = written(search(asked.withColumn("least", F.lit(None).cast("double")), True), "near")
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")
    several = asked.groupBy("vec_id").count().where("count > 1")  # an id with several vectors: its scores don't tell them apart
    kth = kth.join(several, "vec_id", "left_anti")
    rest = search(asked.join(kth, "vec_id", "left").select("vec_id", "dim", "v", "least"), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(embeddings: DataFrame) -> DataFrame:
    v = quantised(embeddings)
    return top_k(v, v.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
