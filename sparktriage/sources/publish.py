"""Result tables that replace an earlier one as a whole, and digests that show whether a table has changed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES = 256


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sibling(spark: SparkSession, path: str, what: str) -> str:
    at, _ = _store(spark, path)
    return f"{at.getParent()}/.{at.getName()}.{what}"


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that was cut short: the new table if it was whole, else the old one, and no leftovers."""
    at, store = _store(spark, path)
    new, old, done = (_store(spark, _sibling(spark, path, x))[0] for x in ("new", "old", "done"))
    if not store.exists(at):
        if store.exists(done):
            store.rename(done, at)
        elif store.exists(old):
            store.rename(old, at)
    for left in (new, old, done) if store.exists(at) else (new,):
        store.delete(left, True)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the table at path by what write(folder) writes.

    The new table is written aside, in a hidden folder beside it, and only a whole one gets a name that counts. Then
    the old one is renamed away and the new one to its place. A job that fails leaves the old rows as they were. Between the two renames a
    reader finds no table; a driver that dies there leaves both tables, and recover(), or the next publish(), puts the new one in place.
    """
    recover(spark, path)
    new, old, done = (_sibling(spark, path, x) for x in ("new", "old", "done"))
    try:
        write(new)
    except BaseException:
        _store(spark, new)[1].delete(_store(spark, new)[0], True)
        raise
    at, store = _store(spark, path)
    moved = lambda a, b: store.rename(_store(spark, a)[0], _store(spark, b)[0])
    if not moved(new, done) or store.exists(at) and not moved(path, old) or not moved(done, path):
        recover(spark, path)
        raise OSError(f"{path} could not be replaced")
    recover(spark, path)


def write_parquet(rows: DataFrame, path: str) -> None:
    publish(rows.sparkSession, path, rows.write.parquet)


def write_json(rows: DataFrame, path: str) -> None:
    publish(rows.sparkSession, path, lambda to: rows.write.json(to, ignoreNullFields=False))


def digest_leaves(rows: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """leaf, n, s0 .. s3: rows are hashed by sha2 of all their columns by name, dealt to leaves by hash, and the parts of their hashes added up.

    Sums know no order, so neither files nor partitions nor the order of rows and columns matter; repeated rows count each time.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(row.alias("h")).groupBy(F.pmod(F.xxhash64("h"), F.lit(leaves)).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])


def table_digest(rows: DataFrame, leaves: int = LEAVES) -> str:
    """The root over the leaves and the schema: sha256 in hex. Of any number of rows, `leaves` lines reach the driver."""
    held = digest_leaves(rows, leaves).orderBy("leaf").collect()
    kinds = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(rows.schema.fields, key=lambda f: f.name))
    return hashlib.sha256("\n".join([kinds, *(" ".join(map(str, r)) for r in held)]).encode()).hexdigest()
