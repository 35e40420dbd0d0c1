"""Per-account features: aggregates by account, joined once; the label and its proxies kept out."""

from __future__ import annotations

import logging
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_medians
from ..sources.tables import written
from ..sources.transactions import COLUMNS, legs

NEEDED = ("timestamp", "from_account", "to_account", "amount_paid", "row_nr", "amount_received")
# fixed values: names that would leak the label or carry none of the behaviour
EXCLUDED = (
    "is_laundering", "pattern_label", "net_flow", "balance_delta", "total_in_minus_out", "running_balance_delta", "cumulative_net_flow",
    "name", "kyc_risk", "receiving_currency_concentration", "payment_currency_concentration",
)
KNOWN = (*COLUMNS, "row_nr")  # of a transaction; its label is among them and is never selected
# fixed values: the features in the order of the output
FEATURES = (
    "outbound_count", "inbound_count", "in_out_ratio", "amount_mean", "amount_std", "amount_max", "amount_skew", "round_amount_ratio",
    "unique_out_recipients", "out_diversity", "unique_in_senders", "in_diversity", "off_hours_fraction", "txn_hour_entropy", "avg_daily_velocity",
)
ZERO = ("outbound_count", "inbound_count", "unique_out_recipients", "unique_in_senders", "round_amount_ratio", "off_hours_fraction", "txn_hour_entropy", "day_range")
MEDIAN = ("amount_mean", "amount_std", "amount_max", "amount_skew")
log = logging.getLogger(__name__)


def guard(columns: list[str]) -> None:
    """ValueError if an excluded name is among the columns."""
    if held := [c for c in EXCLUDED if c in columns]:
        raise ValueError(f"excluded columns among the features' input: {', '.join(held)}")


def log_excluded(path: Path | None = None) -> list[str]:
    """One line an excluded feature with the time (UTC), to the log and, if asked for, to the end of a file of the driver, whose folder is made."""
    now = datetime.now(UTC).isoformat(timespec="seconds")
    lines = [f"{now} excluded feature: {c}" for c in EXCLUDED]
    for line in lines:
        log.info(line)
    if path is not None:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a") as f:
            f.write("".join(f"{line}\n" for line in lines))
    return lines


def clean_input(tx: DataFrame, known: tuple[str, ...] = KNOWN) -> DataFrame:
    """The columns that features read, and nothing else.

    Of the input's other columns those of a transaction file are dropped. Any further one is looked at: ValueError if it bears an excluded name.
    """
    guard([c for c in tx.columns if c not in known])
    return tx.select(*[c for c in NEEDED if c in tx.columns])


def outbound(tx: DataFrame) -> DataFrame:
    round_amount = (F.round("amount_paid") % 1000 == 0).cast("double")
    return tx.groupBy(F.col("from_account").alias("account_id")).agg(
        F.count(F.lit(1)).alias("outbound_count"), F.count_distinct("to_account").alias("unique_out_recipients"), F.avg("amount_paid").alias("amount_mean"),
        F.stddev_samp("amount_paid").alias("amount_std"), F.max("amount_paid").alias("amount_max"), F.skewness("amount_paid").alias("amount_skew"),
        F.avg(round_amount).alias("round_amount_ratio"),
    )


def inbound(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.col("to_account").alias("account_id")).agg(F.count(F.lit(1)).alias("inbound_count"), F.count_distinct("from_account").alias("unique_in_senders"))


def timing(tx: DataFrame) -> DataFrame:
    """First and last time, day range and off-hours share over the stacked legs (a self-transfer counts twice)."""
    hour = F.hour("timestamp")
    return legs(tx).groupBy(F.col("account").alias("account_id")).agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        ((F.max("us") - F.min("us")) / F.lit(8.64e10)).alias("day_range"), F.avg(((hour < 7) | (hour > 20)).cast("double")).alias("off_hours_fraction"),
    )


def hour_entropy(tx: DataFrame) -> DataFrame:
    """Shannon entropy (base 2) of the hours of day; totals come from the same grouped rows, without a join."""
    each = legs(tx).groupBy(F.col("account").alias("account_id"), F.hour("timestamp").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("account_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("account_id", (F.log2("t") - F.col("s") / F.col("t")).alias("txn_hour_entropy"))


def account_aggregates(tx: DataFrame) -> DataFrame:
    """outbound(), inbound(), timing() and hour_entropy() of every account in one aggregate over one scan of the stacked legs.

    Moments are merged from the tasks' partial ones; the entropy comes from 24 counts; the two sets of counterparties are the only rows a key
    that meet, and Spark counts them apart, partially first.
    """
    out, paid = F.col("side") == "o", F.when(F.col("side") == "o", F.col("amount"))
    hour = F.hour("timestamp")
    held = legs(tx).withColumn("h", hour).groupBy(F.col("account").alias("account_id")).agg(
        F.count_if(out).alias("outbound_count"), F.count_if(~out).alias("inbound_count"), F.count_distinct(F.when(out, F.col("cp"))).alias("unique_out_recipients"), F.count_distinct(F.when(~out, F.col("cp"))).alias("unique_in_senders"),
        F.avg(paid).alias("amount_mean"), F.stddev_samp(paid).alias("amount_std"), F.max(paid).alias("amount_max"), F.skewness(paid).alias("amount_skew"), F.avg((F.round(paid) % 1000 == 0).cast("double")).alias("round_amount_ratio"),
        ((F.max("us") - F.min("us")) / F.lit(8.64e10)).alias("day_range"), F.avg(((F.col("h") < 7) | (F.col("h") > 20)).cast("double")).alias("off_hours_fraction"), *[F.count_if(F.col("h") == k).alias(f"h{k}") for k in range(24)],
    )
    n = [F.col(f"h{k}") for k in range(24)]
    total = sum(n[1:], n[0])
    bits = [F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)) for x in n]
    entropy = F.when(total > 0, F.log2(total) - sum(bits[1:], bits[0]) / total)
    return held.withColumn("txn_hour_entropy", entropy).drop(*[f"h{k}" for k in range(24)])


def feature_matrix(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id and the 15 features as floats, from one aggregate by account.

    It is written once: the medians that fill gaps, and every later pass, read that table. It runs jobs at once.
    """
    m = accounts.select("account_id").join(account_aggregates(clean_input(tx)), "account_id", "left")
    m = written(m.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ZERO}), "features")
    out, into = F.col("outbound_count"), F.col("inbound_count")
    fill = exact_medians(m, MEDIAN)
    m = m.withColumns({
        "in_out_ratio": into / (out + 1), "out_diversity": F.col("unique_out_recipients") / (out + 1),
        "in_diversity": F.col("unique_in_senders") / (into + 1), "avg_daily_velocity": (out + into) / (F.col("day_range") + 1),
    })
    filled = [F.nanvl(F.coalesce(F.col(c), F.lit(fill[c] or 0.0)), F.lit(0.0)).alias(c) if c in MEDIAN else F.col(c) for c in FEATURES]
    return m.select("account_id", *[c.cast("float").alias(n) for c, n in zip(filled, FEATURES, strict=True)])
