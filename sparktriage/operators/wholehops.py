"""Whole two-hop lists. Accounts are numbered in order of id; sets of numbers are cut into blocks, and sets at two steps are made tile by tile like a product of bit matrices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..sources.tables import written


@dataclass(frozen=True)
class Sizes:
    block: int = 1 << 15  # numbers of a block, a multiple of 8 and at most 2^16
    sparse: int = 1 << 11  # places of a block from which bits are kept; at most block / 16
    group: int = 512  # accounts of a tile
    span: int = 1 << 16  # neighbours of a tile
    spelled: int = 128  # accounts that are spelled at once
    batch: int = 1 << 20  # ids of a batch of results


def _bytes(places: np.ndarray, z: Sizes) -> bytes:
    """Up to sparse - 1 places as 16-bit numbers, more as the bits of the block: the length tells which."""
    if len(places) < z.sparse:
        return np.asarray(places).astype(np.uint16).tobytes()
    bits = np.zeros(z.block, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _bits(held: bytes, z: Sizes) -> np.ndarray:
    if len(held) == z.block // 8:
        return np.frombuffer(held, np.uint8)
    bits = np.zeros(z.block, bool)
    bits[np.frombuffer(held, np.uint16)] = True
    return np.packbits(bits, bitorder="little")


def _numbered(ids: DataFrame) -> DataFrame:
    """account, nr: places in order of id from 0, by range partitions with offsets. Written at once."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(ids.repartitionByRange(n, "account").withColumn("p", F.spark_partition_id()), "ids")  # partitions stay as they are
    sizes = part.groupBy("p").agg(F.count(F.lit(1)).alias("t"))
    before = sizes.select("p", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return written(part.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("account"))).join(before, "p").select("account", (F.col("o") + F.col("k") - 1).alias("nr")), "numbers")


def _tile(z: Sizes) -> Callable[[pa.Table], pa.Table]:
    """A tile: sets of neighbours in one block, each joined into those of the accounts that have the neighbour."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, held = t["own"].chunk(0), t["places"].to_pylist()
        flat, n_own = own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n_own) - n_own
        n = np.array([z.sparse if len(h) == z.block // 8 else len(h) // 2 for h in held], np.int64)
        few = n * n_own < z.sparse
        bits = np.zeros((z.group, z.block // 8), np.uint8)
        for i in np.flatnonzero(~few):
            bits[flat[start[i] : start[i] + n_own[i]]] |= _bits(held[i], z)
        rows = np.flatnonzero(few)
        if len(rows):
            seen = np.zeros((z.group, z.block), bool)
            for some in np.array_split(rows, -(-len(rows) // z.sparse)):  # at most sparse^2 pairs at once
                places, at = np.frombuffer(b"".join([held[i] for i in some]), np.uint16), np.cumsum(n[some]) - n[some]
                row = np.repeat(np.arange(len(some)), n_own[some])
                account = flat[np.arange(len(row)) + np.repeat(start[some] - (np.cumsum(n_own[some]) - n_own[some]), n_own[some])]
                long = n[some][row]
                seen[np.repeat(account, long), places[np.arange(long.sum()) + np.repeat(at[row] - (np.cumsum(long) - long), long)]] = True
            bits |= np.packbits(seen, axis=1, bitorder="little")
        found = np.flatnonzero(bits.any(axis=1))
        sets = [_bytes(np.flatnonzero(np.unpackbits(bits[i], bitorder="little")), z) for i in found]
        g, block = t["g"][0].as_py(), t["block"][0].as_py()
        return pa.table({"nr": pa.array(found + g * z.group, pa.int64()), "block": pa.array([block] * len(found), pa.int64()), "places": pa.array(sets, pa.binary())})

    return run


def _speller(columns: list[str], sep: str | None, z: Sizes) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows with the sets far and near, and the ids of the blocks that far reaches: far without near and the account itself, as ids in order."""

    def run(rows: pa.Table, named: pa.Table) -> pa.Table:
        named = named.sort_by("block")
        at = {b: i for i, b in enumerate(named["block"].to_pylist())}  # only the last block of all can be short, so ids stand at block x i + place
        ids = pa.concat_arrays([c.flatten() for c in named["ids"].chunks]) if at else pa.array([], pa.string())
        kept, out, places, ends = rows.select(columns), [], [], [0]
        first = 0
        for i, (nr, far, near) in enumerate(zip(rows["nr"].to_pylist(), rows["far"].to_pylist(), rows["near"].to_pylist(), strict=True)):
            if far:
                bits = np.zeros((len(at), z.block // 8), np.uint8)
                for s in far:
                    bits[at[s["block"]]] |= _bits(s["places"], z)
                for s in near or []:
                    if s["block"] in at:
                        bits[at[s["block"]]] &= ~_bits(s["places"], z)
                if nr // z.block in at:
                    bits[at[nr // z.block], nr % z.block // 8] &= ~np.uint8(1 << nr % 8)
                places.append(np.flatnonzero(np.unpackbits(bits.ravel(), bitorder="little")))
            ends.append(ends[-1] + (len(places[-1]) if far else 0))
            if ends[-1] >= z.batch or i + 1 == len(rows):
                hop2 = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *places]))))
                out.append(kept.slice(first, i + 1 - first).append_column("hop2", hop2 if sep is None else pc.binary_join(hop2, sep)))
                first, places, ends = i + 1, [], [0]
        return pa.concat_tables(out) if out else kept.append_column("hop2", pa.array([], pa.list_(pa.string()) if sep is None else pa.string()))

    return run


def _part(c: str, size: int) -> Column:
    return F.expr(f"{c} div {size}")


def _places(c: str, size: int) -> Column:
    return F.collect_list((F.col(c) % size).cast("int"))


def with_hop2(rows: DataFrame, e: DataFrame, sep: str | None = None, z: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """rows with hop2, all ids at two steps of account_id in order, without the account and its neighbours; empty where there are none; with `sep` as one string. Ids, edges and sets are written at once.

    A tile is 512 accounts, 65,536 neighbours and a block of 32,768 ids: a set of a neighbour goes once to a tile, not once an edge, as bits or as places. Ids take
    the place of bits in the last step, so lists are never shuffled.
    """
    asked = rows.select(F.col("account_id").alias("account")).where("account is not null").distinct()
    numbers = _numbered(e.select("account").unionByName(asked).distinct())
    packed = F.pandas_udf(lambda x: x.map(lambda places: _bytes(places, z)), BinaryType())
    by = lambda old, new: numbers.select(F.col("account").alias(old), F.col("nr").alias(new))
    pairs = written(e.join(by("account", "a"), "account").join(by("cp", "b"), "cp").select("a", "b"), "pairs")
    sets = written(pairs.groupBy("a", _part("b", z.block).alias("block")).agg(_places("b", z.block).alias("places")).select(F.col("a").alias("b"), "block", packed("places").alias("places")), "sets")

    start = pairs.join(asked.join(numbers, "account").select(F.col("nr").alias("a")), "a", "left_semi")
    own = start.groupBy(_part("a", z.group).alias("g"), "b").agg(_places("a", z.group).alias("own"))
    tiles = own.join(sets, "b").withColumn("span", _part("b", z.span)).groupBy("g", "block", "span")
    met = written(tiles.applyInArrow(_tile(z), "nr long, block long, places binary"), "met")

    listed = F.collect_list(F.struct("block", "places"))
    far, near = met.groupBy("nr").agg(listed.alias("far")), sets.groupBy(F.col("b").alias("nr")).agg(listed.alias("near"))
    to = F.coalesce(_part("nr", z.spelled), F.lit(-1)).alias("to")  # -1: a row without an account
    left = rows.join(by("account_id", "nr"), "account_id", "left").join(far, "nr", "left").join(near, "nr", "left").select("*", to)
    spelled = numbers.groupBy(_part("nr", z.block).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "account"))), lambda x: x["account"]).alias("ids"))
    right = met.select(to, "block").distinct().join(spelled, "block")
    schema = StructType([*rows.schema, StructField("hop2", ArrayType(StringType()) if sep is None else StringType())])
    return left.groupBy("to").cogroup(right.groupBy("to")).applyInArrow(_speller(rows.columns, sep, z), schema)
