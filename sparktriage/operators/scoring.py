"""Robust outlier scores and average-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_medians
from ..sources.tables import written
from .features import FEATURES

CLIP, MAD, EPS, FLAG = 25.0, 1.4826, 1e-8, 0.995


def _stats(features: DataFrame) -> list[tuple[str, float, float, float]]:
    """(feature, median, mad, std) of the fifteen columns."""
    x = {c: F.col(c).cast("double") for c in FEATURES}
    mid = {c: m or 0.0 for c, m in exact_medians(features, x).items()}
    mad = exact_medians(features, {c: F.abs(x[c] - F.lit(mid[c])) for c in FEATURES})
    std = features.agg(*[F.stddev_pop(x[c]).alias(c) for c in FEATURES]).first().asDict()
    return [(c, mid[c], mad[c] or 0.0, std[c] or 0.0) for c in FEATURES]


def robust_stats(features: DataFrame) -> DataFrame:
    """feature, median, mad, std: fifteen rows. It runs jobs at once."""
    return features.sparkSession.createDataFrame(_stats(features), "feature string, median double, mad double, std double")


def robust_scores(features: DataFrame) -> DataFrame:
    """account_id, score: mean of clipped |x - median| / scale over the features, rounded so that equal rows tie. One narrow pass, after the jobs for the statistics, which run at once."""
    z = []
    for c, mid, mad, std in _stats(features):
        scale = MAD * mad if mad > 0 else std + EPS
        z.append(F.least(F.abs(F.col(c).cast("double") - F.lit(mid)) / F.lit(scale), F.lit(CLIP)))
    return features.select("account_id", F.round(sum(z[1:], z[0]) / len(FEATURES), 9).alias("score"))


def score_of(scores: DataFrame, accounts: DataFrame) -> DataFrame:
    """The score rows of the accounts asked for; nulls where an account has none."""
    return accounts.select("account_id").join(scores, "account_id", "left")


def percentiles(scores: DataFrame) -> DataFrame:
    """account_id, score, percentile, is_flagged. Ties share the mean rank.

    Distinct scores are counted first; ranks are running sums of range-partitioned counts with an offset a partition,
    so no task sorts all scores. Their counts are written; that job runs at once.
    """
    spark = scores.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    part = written(counts.repartitionByRange(n, "score").withColumn("p", F.spark_partition_id()), "ranks")  # partitions stay as they are
    run = Window.partitionBy("p").orderBy("score")
    part = part.withColumn("e", F.sum("c").over(run))
    sizes = part.groupBy("p").agg(F.sum("c").alias("t"))
    offsets = sizes.select("p", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("n"))
    ranked = part.join(offsets, "p").select("score", ((2 * (F.col("e") + F.col("o")) - F.col("c") + 1) / 2 / F.col("n")).alias("percentile"))
    return scores.join(ranked, "score").select("account_id", "score", "percentile", (F.col("percentile") >= FLAG).alias("is_flagged"))
