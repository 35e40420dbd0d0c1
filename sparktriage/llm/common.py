"""Shared plumbing of the training-data operators: table access, durable intermediate tables, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import release, remove, shared_dir, table_mark, written

__all__ = ["release", "shared_dir", "table_mark", "written"]

KEYS = 1 << 62
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by written(), once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df only if its counted rows are within the bound; beyond it the join shuffles (AQE splits hot keys)."""
    return F.broadcast(df) if rows <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m, the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def sample_below(most: int, n: int) -> int:
    """Of KEYS equally likely keys, as many as take about `most` of n rows: never none of them, at any n that Spark can count."""
    return min(KEYS, max(1, KEYS * most // n)) if n else KEYS


def labelled_sample(labels: DataFrame, most: int, seed: str) -> DataFrame:
    """At most about `most` rows of labels, chosen by a hash of doc_id: the documented bound of a classifier's fit."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(KEYS)) < F.lit(sample_below(most, n)))


def bounded_labels(labels: DataFrame, most: int, seed: str) -> DataFrame:
    """As labelled_sample, and never more than `most` rows, also where ids repeat: it may be broadcast."""
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return labelled_sample(labels, most, seed).orderBy(key, *labels.columns).limit(most)


def keep_first(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group, with all its columns. groups(root, doc_id, hash): a line for every row of documents, hash = xxhash64(text).

    The row of the smallest doc_id stays (null after all others), then that of the smallest hash, then one of the rows that
    are equal in both, in the order of all columns.
    """
    own, mark, n, k = (fresh(documents, c) for c in ("own_id", "own_hash", "copies", "place"))
    rows = groups.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n")).alias("r"))
    least = written(least.select(F.col("r.doc_id").alias(own), F.col("r.hash").alias(mark), F.col("r.n").alias(n)), "kept")
    key = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark))
    if least.where(F.col(n) > 1).isEmpty():
        return documents.join(least, key, "left_semi")
    single = documents.join(least.where(F.col(n) == 1), key, "left_semi")
    again = documents.join(least.where(F.col(n) > 1), key)
    order = Window.partitionBy(own, mark).orderBy(*documents.columns)
    return single.union(again.withColumn(k, F.row_number().over(order)).where(F.col(k) == 1).select(*documents.columns))
