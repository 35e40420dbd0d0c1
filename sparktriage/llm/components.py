"""Connected components of an edge list by alternating large-star and small-star steps; no edge leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u goes to the least of u and its neighbours; small: u and its smaller ones do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge list: equal before and after a step once the stars are stable."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b: long) to (node, root): root is the least node of the component; only nodes of an edge are listed.

    The least neighbour is found by a partial aggregate and hot stars are split by AQE's skewed joins. Rounds grow with
    the logarithm of the largest component; each is written to the shared folder, which cuts the lineage.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        new = written(_star(_star(now, True), False), "edges")
        drop_table(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
