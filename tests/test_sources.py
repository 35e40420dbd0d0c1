"""Splittable block files, tables that are replaced as a whole, digests of tables, medians of many rows."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktriage.functions import quantiles
from sparktriage.sources import files, publish


def plain_blocks(lines):
    out, name, held = set(), None, []
    for x in lines:
        low = " ".join(x.lower().split())
        if low.startswith("begin laundering attempt"):
            name, held = x.split("-", 1)[1].split(":")[0].strip(), []
        elif low.startswith("end laundering attempt"):
            out |= {(name, a) for a in held if name is not None}
            name, held = None, []
        elif name is not None and len(p := x.split(",")) > 4:
            held += [a.strip() for a in (p[2], p[4]) if a.strip()]
    return out


def test_blocks_over_many_splits(spark, tmp_path):
    """Blocks within a split, over two, and over many; open, nested and unnamed ones; several tasks read the file."""
    rng, lines = random.Random(2), ["noise", "2022,B,stray,B,stray2,1", "END LAUNDERING ATTEMPT - X"]
    for k in range(300):
        lines.append(rng.choice(["BEGIN LAUNDERING ATTEMPT - T{}: max 3", "begin  laundering\tattempt -  T{}", "  BEGIN LAUNDERING ATTEMPT - T{}:"]).format(k % 23))
        lines += [f"2022/01/01 00:00,B,a{rng.randrange(400)},B, b{rng.randrange(400)} ,1.0,USD" for _ in range(900 if k == 50 else rng.randrange(6))]
        lines += [rng.choice(["END LAUNDERING ATTEMPT - T", "End  Laundering  Attempt", "short,line", "2022,B,lost,B,lost2,1"])]
    lines += ["BEGIN LAUNDERING ATTEMPT - OPEN", "2022,B,open1,B,open2,1"]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        (tmp_path / name).write_bytes(end.join(lines if name == "a" else lines[5:]).encode())
    want = plain_blocks(lines) | plain_blocks(lines[5:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {tuple(r) for r in files.block_patterns(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(want) > 500 and not {"open1", "stray", "lost"} & {a for _, a in got}


def test_a_failed_job_leaves_the_old_rows(spark, tmp_path):
    at = f"{tmp_path}/t"
    publish.write_parquet(spark.range(10), at)
    publish.write_parquet(spark.range(20), at)
    assert spark.read.parquet(at).count() == 20
    late = spark.range(1000).repartition(8).withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.lit("y")))
    for write in (publish.write_parquet, publish.write_json):
        with pytest.raises(Exception, match="lost"):
            write(late, at)
        assert spark.read.parquet(at).count() == 20
    publish.write_parquet(spark.read.parquet(at).where("id < 5"), at)  # it reads what it replaces
    assert spark.read.parquet(at).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    publish.write_json(spark.range(3), at)
    assert spark.read.json(at).count() == 3


def test_a_driver_that_dies_between_the_renames(spark, tmp_path):
    at = tmp_path / "t"
    for left, want in ((("done", "old"), 7), (("old", "new"), 4)):
        for what, n in {"done": 7, "old": 4, "new": 1}.items():
            if what in left:
                spark.range(n).write.parquet(f"{tmp_path}/.t.{what}")
        publish.recover(spark, str(at))
        assert spark.read.parquet(str(at)).count() == want and len(list(tmp_path.iterdir())) == 1
        Path(at).rename(tmp_path / f"kept{want}")
        (tmp_path / f"kept{want}").rename(tmp_path.parent / f"{tmp_path.name}-kept{want}")


def test_digest_of_a_table(spark, tmp_path):
    rows = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("d"))
    rows.write.parquet(f"{tmp_path}/t")
    m = files.Manifest(tmp_path / "sums", tmp_path)
    with pytest.raises(ValueError, match="session"):
        m.freeze(tmp_path / "t")
    m.freeze(tmp_path / "t", spark=spark)
    m.verify(spark)
    assert list(m.entries()) == ["t/"]
    same = rows.repartition(7).select("d", "s", "id")  # other files, another order of rows and columns
    assert publish.table_digest(same) == m.entries()["t/"]
    for other in (rows.withColumn("s", F.when(F.col("id") == 1234, "x").otherwise(F.col("s"))), rows.where("id <> 9"), rows.union(rows.where("id = 9")), rows.withColumn("d", F.coalesce("d", F.lit(0.0))), rows.withColumn("id", F.col("id").cast("int"))):
        assert publish.table_digest(other) != m.entries()["t/"]
    publish.write_parquet(rows.withColumn("d", F.when(F.col("id") == 42, -1.0).otherwise(F.col("d"))), f"{tmp_path}/t")
    with pytest.raises(ValueError, match="changed"):
        m.verify(spark)


def test_medians_by_radix_select(spark):
    """A million rows and no value held: both middle ranks, ties, nulls, infinities, signs and zeros."""
    n = 1_000_001
    df = spark.range(n).select(
        (F.rand(3) * 1000 - 500).alias("a"), F.when(F.col("id") % 3 > 0, F.exp(F.randn(4) * 50) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)).alias("b"), F.lit(None).cast("double").alias("c"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"), F.when(F.col("id") < 10, F.col("id").cast("double") - 5).alias("few"), F.when(F.col("id") % 3 == 0, float("inf")).otherwise(float("-inf")).alias("inf"),
    )
    got = quantiles.exact_medians(df, df.columns, at_once=1)
    held = df.select("a", "b").toPandas()
    want = {"a": float(np.median(held["a"])), "b": float(np.median(held["b"].dropna())), "c": None, "z": 0.0, "few": -0.5, "inf": float("-inf")}
    assert got == want
    assert quantiles.exact_medians(df.where("id = 4"), ["few"], at_once=0) == {"few": -1.0}
