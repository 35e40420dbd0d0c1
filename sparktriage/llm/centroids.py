"""Clustering of integer vectors around centroids, exact: distances by matrix products, sums by an aggregation tree.

Vectors are written once as blocks of rows, in the narrowest integer type that holds them. A block's squared distances are
|x|^2 - 2 x.c + |c|^2 with x.c a float64 matrix product. All of its terms are integers; while dim * (|x| + |c|)^2 stays under 2^53
for the largest components, every partial sum is exact in float64, in any order. Beyond that bound int64 is used, and Python's
integers beyond 2^63. Sums of a cluster's vectors are Python integers merged by RDD.treeAggregate, k rows of dim a partition.

Defined results: vectors that are null, of another length than dim, or hold null or non-finite components take no part; with
fewer kept vectors than k every one is a centroid; repeated rows and ids count as often as they stand there, null ids come last among
the first centroids; a distance or sum beyond a long is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIM, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
BLOCK = 4096  # vectors of a block
_EXACT, _LONG = 1 << 53, 1 << 63


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as integers of the narrowest type (objects beyond int64)."""
    top = float(np.abs(x).max(initial=0.0))
    if top * scale < 2.0**62:
        y = np.floor(x * scale).astype(np.int64)
        low, high = int(y.min(initial=0)), int(y.max(initial=0))
        return y.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    whole = lambda v: math.floor(v * scale) if abs(v) < 2.0**900 else int(v) * scale
    return np.array([whole(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _bytes(x: np.ndarray) -> tuple[str, bytes]:
    return ("object", ",".join(map(str, x.ravel().tolist())).encode()) if x.dtype == object else (x.dtype.str, x.tobytes())


def _array(kind: str, data: bytes, dim: int) -> np.ndarray:
    x = np.array([int(v) for v in data.split(b",")], object) if kind == "object" else np.frombuffer(data, kind)
    return x.reshape(-1, dim)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x (integers) to all rows of c."""
    top = max((abs(int(v)) for a in (x, c) for v in (a.min(initial=0), a.max(initial=0))), default=0)
    bound = x.shape[1] * 4 * top * top
    if bound < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if bound < _LONG else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), kind)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; the smaller number of equals."""
    d = squared_distances(x, c)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def integer_blocks(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """ids, kind, data: rows of at most `block` kept vectors each, as integers."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    x = F.transform("embedding", lambda v: v.cast("double"))
    kept = vectors.select("vec_id", x.alias("x")).where(F.size("x") == dim)
    kept = kept.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                kind, data = _bytes(_scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([kind]), pa.array([data], pa.binary())], ["ids", "kind", "data"])

    return kept.mapInArrow(run, f"ids array<{id_type}>, kind string, data binary")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, dim: int = DIM, scale: int = SCALE) -> list[list[int]]:
    """The k kept vectors whose sha256 of `1:<vec_id>` is least, in that order; ties by their components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    kept = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), x.alias("x")).where(F.size("x") == dim)
    kept = kept.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = kept.orderBy(F.col("h").isNull(), "h", "x").limit(k).collect()  # k rows
    return _scaled(np.array([r.x for r in rows], np.float64).reshape(-1, dim), scale).tolist()


def _matrix(c: list[list[int]], dim: int) -> np.ndarray:
    big = any(abs(v) >= 1 << 62 for row in c for v in row)
    return np.array(c, object if big else np.int64).reshape(-1, dim)


def _sums(held, dim: int):
    """Adds a block's vectors to the sums and counts of their nearest centroids, and their distances to its inertia."""

    def run(acc: list, block) -> list:
        c = held.value
        x = _array(block.kind, bytes(block.data), dim)
        at, d = nearest(x, c)
        for j in np.unique(at).tolist():
            own = x[at == j]
            wide = own.dtype == object or int(np.abs(own.astype(np.int64)).max()) * len(own) >= 1 << 62
            s = [int(v) for v in own.astype(object if wide else np.int64).sum(0)]
            n, old, inertia = acc.get(j, (0, [0] * dim, 0))
            acc[j] = (n + len(own), [a + b for a, b in zip(old, s, strict=True)], inertia + sum(map(int, d[at == j])))
        return acc

    return run


def _added(a: dict, b: dict) -> dict:
    for j, (n, s, d) in b.items():
        m, old, e = a.get(j, (0, [0] * len(s), 0))
        a[j] = (n + m, [x + y for x, y in zip(old, s, strict=True)], d + e)
    return a


def fit_centroids(blocks: DataFrame, start: list[list[int]], rounds: int = ROUNDS, dim: int = DIM) -> tuple[list[list[int]], dict[int, int]]:
    """Centroids after so many rounds, and the inertia of each cluster under them. A job a round; k rows of dim reach the driver."""
    c, sc = start, blocks.sparkSession.sparkContext
    rows = blocks.select("kind", "data").rdd
    for _ in range(rounds):
        got = rows.treeAggregate({}, _sums(sc.broadcast(_matrix(c, dim)), dim), _added) if c else {}
        c = [[v // got[j][0] for v in got[j][1]] if j in got else row for j, row in enumerate(c)]
    got = rows.treeAggregate({}, _sums(sc.broadcast(_matrix(c, dim)), dim), _added) if c else {}
    return c, {j: d for j, (_, _, d) in got.items()}


def assign(blocks: DataFrame, centroids: list[list[int]], dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance of every vector of the blocks."""
    held = blocks.sparkSession.sparkContext.broadcast(_matrix(centroids, dim))
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                at, d = nearest(_array(b.column(1)[k].as_py(), b.column(2)[k].as_py(), dim), held.value)
                far = pa.array([int(v) if v < _LONG else None for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(at.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "kind", "data").mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def op13_centroids(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    spark = vectors.sparkSession
    blocks = written(integer_blocks(vectors, dim, scale), "vector-blocks")
    c, inertia = fit_centroids(blocks, first_centroids(vectors, k, dim, scale), rounds, dim)
    fits = lambda v: v if v < _LONG else None
    told = [(j, fits(inertia.get(j, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(c)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(blocks, c, dim).join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
a{n} as (select vec_id, r, v, k as cluster, d from (select e.vec_id, e.r, e.v, c.k, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2])::hugeint * (z[1] - z[2]))) as d from e, c{n} c)
  qualify row_number() over (partition by r order by d, k) = 1),
s{n} as (select cluster, i, sum(v[i]) as s, count(*) as n from a{n}, range(1, 65) t(i) group by cluster, i),
c{m} as (select c.k, coalesce(f.v, c.v) as v from c{n} c left join (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from s{n} group by cluster) f on f.cluster = c.k),"""
ORACLE = (
    """
with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v from e qualify k < 16),"""
    + "".join(_ROUND.format(n=n, m=n + 1) for n in range(ROUNDS + 1))
    + """
h as (select k, sha256(array_to_string(v, ',')) as centroid_sha256 from c3)
select vec_id, cluster::integer as cluster, d::bigint as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from a3 join h on h.k = a3.cluster
"""
)
