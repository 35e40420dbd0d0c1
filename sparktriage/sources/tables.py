"""Durable intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode a temporary folder will do where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_TABLES: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def release(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Delete the tables written between two marks, once the results that read them are themselves written or done with."""
    for path in _TABLES[since:upto]:
        remove(spark, path)
    del _TABLES[since:upto]


def table_mark() -> int:
    """A mark for release(): tables written from now on come after it."""
    return len(_TABLES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors.

    The files go with release(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(release, spark)
    _TABLES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
