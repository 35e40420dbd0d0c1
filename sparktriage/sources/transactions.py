"""Transactions: the physical schema, the CSV source with its format probe, and the view over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the file's columns in order, its timestamp formats and null tokens
COLUMNS = ("timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")
SCHEMA = T.StructType([T.StructField(c, T.TimestampNTZType() if c == "timestamp" else T.DoubleType() if c.startswith("amount") else T.ByteType() if c == "is_laundering" else T.StringType()) for c in COLUMNS])
FORMATS = ("yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")
SHAPES = (r"\d{4}/\d\d/\d\d \d\d:\d\d", r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\d \d\d:\d\d", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d")
NULLS = ("", "NA", "null")


def probe_format(raw: DataFrame) -> str:
    """The first format that the first row's timestamp has; ValueError without rows or without a match."""
    import re

    row = raw.select("timestamp").first()
    if row is None:
        raise ValueError("the file has no data row")
    for shape, fmt in zip(SHAPES, FORMATS, strict=True):
        if re.fullmatch(shape, row[0] or ""):
            return fmt
    raise ValueError(f"no known timestamp format: {row[0]!r}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by position (ids keep leading zeros, the header repeats a name), then cast; row_nr is file order from 0.

    The order is that of paths, then of places in a file: each split's rows are numbered from the count of rows before it.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    raw = spark.read.csv(path, schema=text, header=True, enforceSchema=True)
    fmt = probe_format(raw)
    clean = [F.when(F.trim(c).isin(*NULLS), None).otherwise(F.col(c)).alias(c) for c in COLUMNS]
    kinds = {f.name: f.dataType for f in SCHEMA.fields}
    cast = [F.to_timestamp_ntz("timestamp", F.lit(fmt)).alias(c) if c == "timestamp" else F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS]
    at = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__i")]
    rows = raw.select(*clean, *at)
    before = Window.orderBy("__f", "__s").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = rows.groupBy("__f", "__s").agg(F.min("__i").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    splits = splits.select("__f", "__s", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo")).alias("__base"))
    return rows.join(splits, ["__f", "__s"]).select(*cast, (F.col("__i") + F.col("__base")).alias("row_nr"))


def head_lines(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """Raw first lines, for a look at a file."""
    return spark.read.text(path).limit(n)


def inspect(spark: SparkSession, path: str, n: int = 5) -> dict[str, list]:
    """Header names, what a reader that keeps names apart calls repeated ones, and the first n rows as they are."""
    lines = [r.value for r in head_lines(spark, path, n + 1).collect()]
    names, seen, renamed = (lines[0].split(",") if lines else []), {}, []
    for c in names:
        renamed.append(f"{c}_duplicated_{seen[c]}" if c in seen else c)
        seen[c] = seen.get(c, -1) + 1
    return {"columns": names, "renamed": [(a, b) for a, b in zip(names, renamed, strict=True) if a != b], "rows": lines[1:]}


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as the events table has them: users send to the account in props; `error` stands for the label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    amount = F.round(F.col("value") * 100, 2)
    return e.select(
        F.col("event_id").alias("row_nr"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("from_account"),
        F.get_json_object("props", "$.k").alias("to_account"), amount.alias("amount_paid"), amount.alias("amount_received"),
        F.col("event_type").alias("payment_format"), (F.col("event_type") == "error").cast("int").alias("is_laundering"),
    )


def micros(c: str = "timestamp"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def legs(tx: DataFrame) -> DataFrame:
    """Each transaction as an outbound leg of its sender and an inbound leg of its receiver; one scan, no union."""
    side = lambda s, a, c, m: F.struct(F.lit(s).alias("side"), F.col(a).alias("account"), F.col(c).alias("cp"), F.col(m).alias("amount"))
    both = F.array(side("o", "from_account", "to_account", "amount_paid"), side("i", "to_account", "from_account", "amount_received"))
    return tx.select("row_nr", "timestamp", micros().alias("us"), F.explode(both).alias("l")).select("row_nr", "timestamp", "us", "l.*")
