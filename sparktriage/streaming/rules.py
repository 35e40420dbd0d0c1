"""Streaming form of the fan-out rule, an addition: distinct receivers by sender in sliding days, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_fan_out(tx: DataFrame, least: int = 5, late: str = "1 hour", slide: str = "1 hour") -> DataFrame:
    """account, window, receivers for windows whose set of receivers reaches `least`; state goes with the watermark.

    The set of a window is bounded by the sender's receivers in one day.
    """
    t = tx.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    w = t.groupBy(F.window("at", "24 hours", slide), F.col("from_account").alias("account")).agg(F.collect_set("to_account").alias("to"))
    return w.where(F.size("to") >= least).select("account", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.size("to").alias("receivers"))
