"""Typology rules over account legs: range windows by account, the earliest firing of each rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from ..sources.transactions import legs

DAY = 86_400_000_000
# fixed values: countries of the corridor rule
BLACK = ("MM", "IR", "KP")
HIGH_RISK = (
    "MM", "IR",
    "AL", "BB", "BF", "CM", "CD", "GI", "HT", "JM", "JO", "KE",
    "ML", "MZ", "NA", "NG", "PA", "PH", "SN", "SS", "SY", "TZ",
    "TT", "UG", "VU", "VN", "YE", "ZA",
    "PK", "KP", "AF", "IQ", "LB", "LY", "SO", "SD",
    "CU", "VE",
)

@dataclass(frozen=True)
class Thresholds:
    band_low: float = 8000.0
    band_high: float = 9900.0
    struct_count: int = 3
    pass_ratio: float = 0.80
    fan: int = 5
    last: int | None = None  # transactions of an account that the rules see; None: all


def account_window(tx: DataFrame, last: int | None = 10_000, salts: int = 32) -> DataFrame:
    """Legs of each account's last transactions, all of them if last is None; a self-transfer is one transaction of two legs, so ranks are dense.

    The cut is made twice: by account and salt, so that a hub's legs are sorted in many tasks, then by account.
    """
    rows = legs(tx).where("account is not null")
    if last is None:
        return rows
    rows = rows.withColumn("salt", F.pmod(F.hash("row_nr"), F.lit(salts)))
    recent = (F.desc("us"), F.desc("row_nr"))
    rows = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("account", "salt").orderBy(*recent))).where(F.col("k") <= last)
    return rows.withColumn("k", F.dense_rank().over(Window.partitionBy("account").orderBy(*recent))).where(F.col("k") <= last).drop("k", "salt")


def _until(rows: DataFrame, fired: DataFrame) -> DataFrame:
    """The rows of each account's first firing: its row and those of the trailing day (ends included)."""
    fire = fired.groupBy("account").agg(F.min(F.struct("us", "row_nr")).alias("hi"))
    return rows.join(fire, "account").where((F.struct("us", "row_nr") <= F.col("hi")) & (F.col("us") >= F.col("hi.us") - DAY))


def structuring(window: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Amounts in the band, struct_count or more inside a trailing day: the leg so many places before is no more than a day older."""
    rows = window.where((F.col("side") == "o") & (F.col("amount") >= t.band_low) & (F.col("amount") < t.band_high))
    order = Window.partitionBy("account").orderBy("us", "row_nr")
    held = _until(rows, rows.withColumn("back", F.lag("us", t.struct_count - 1).over(order)).where(F.col("us") - F.col("back") <= DAY)).groupBy("account").agg(
        F.count(F.lit(1)).alias("txn_count"), F.array_sort(F.collect_list(F.struct("us", "row_nr", "amount"))).alias("a"), F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"),
    )
    amounts = F.array_join(F.transform("a", lambda x: F.format_number(x["amount"], 2)), ";")
    return held.select("account", F.lit("STRUCT_001").alias("rule_id"), F.lit(3).alias("severity"), "txn_count", amounts.alias("amounts"), "window_start", "window_end")


def fan(window: DataFrame, side: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Five distinct counterparties or more inside a trailing day, by a sweep: no row holds a list but the one that fires.

    Legs of a counterparty no more than a day apart make one episode. It counts from its first leg to a day after its last,
    so the distinct counterparties at a leg are the episodes begun less those that have ended: a running sum.
    """
    rows = window.where(F.col("side") == side).where("cp is not null and us is not null")
    own = Window.partitionBy("account", "cp").orderBy("us", "row_nr")
    apart = rows.select("account", "us", "row_nr", (F.col("us") - F.lag("us").over(own)).alias("gap"), (F.lead("us").over(own) - F.col("us")).alias("wait"))
    event = lambda on, us, kind, step: F.when(on, F.struct(us.alias("us"), F.lit(kind).alias("kind"), F.lit(step).alias("step")))
    begins, ends = F.col("gap").isNull() | (F.col("gap") > DAY), F.col("wait").isNull() | (F.col("wait") > DAY)
    both = F.array(event(begins, F.col("us"), 0, 1), event(ends, F.col("us") + DAY, 1, -1))
    events = apart.select("account", "row_nr", F.explode(F.array_compact(both)).alias("e")).select("account", "row_nr", "e.*")
    sweep = Window.partitionBy("account").orderBy("us", "kind", "row_nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = events.withColumn("held", F.sum("step").over(sweep)).where((F.col("kind") == 0) & (F.col("held") >= t.fan))
    held = _until(rows, full).groupBy("account").agg(F.array_sort(F.collect_set("cp")).alias("ids"), F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"))
    rule = "FAN_OUT_001" if side == "o" else "FAN_IN_001"
    return held.select(
        "account", F.lit(rule).alias("rule_id"), F.lit(2).alias("severity"), F.size("ids").cast("long").alias("n_counterparties"),
        F.array_join(F.slice("ids", 1, 20), ";").alias("counterparties"), "n_rows", "window_start", "window_end",
    )


def passthrough(window: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Inbound followed within a day, both ends exclusive, by outbound of at least the ratio.

    Legs meet by account and day, an inbound one in its own day and the next: a hub is dealt by days, and its inbound legs never meet each other.
    """
    day = (F.col("us") - F.pmod("us", F.lit(DAY))) / F.lit(DAY)
    into = window.where("side = 'i' and amount > 0").withColumn("day", F.explode(F.array(day, day + 1))).select("account", "day", "us", "row_nr", "timestamp", "amount")
    out = window.where("side = 'o'").select("account", day.alias("day"), F.col("us").alias("out_us"), F.col("amount").alias("out"), F.col("timestamp").alias("out_at"))
    met = into.join(out, ["account", "day"]).where((F.col("out_us") > F.col("us")) & (F.col("out_us") < F.col("us") + DAY))
    sums = met.groupBy("account", "us", "row_nr", "timestamp", "amount").agg(F.sum("out").alias("out_sum"), F.count(F.lit(1)).alias("out_n"), F.max("out_at").alias("out_end"))
    fire = sums.withColumn("ratio", F.col("out_sum") / F.col("amount")).where(F.col("ratio") >= t.pass_ratio)
    fire = fire.groupBy("account").agg(F.min(F.struct("us", "row_nr", "timestamp", "amount", "out_sum", "out_n", "out_end", "ratio")).alias("f")).select("account", "f.*")
    return fire.select(
        "account", F.lit("PASSTHROUGH_001").alias("rule_id"), F.lit(3).alias("severity"), F.round("amount", 4).alias("inbound_amount"), F.round("out_sum", 4).alias("outbound_sum"),
        F.round("ratio", 4).alias("ratio"), F.col("out_n").alias("n_outbound"), F.col("timestamp").alias("window_start"), F.col("out_end").alias("window_end"),
    )


def corridor(profiles: DataFrame, tx: DataFrame, high_risk: tuple[str, ...] = HIGH_RISK, black: tuple[str, ...] = BLACK) -> DataFrame:
    """Accounts whose own country is of high risk; the window is their first to last time, the epoch without any."""
    risky = profiles.where(F.col("country").isin(*high_risk)).select(F.col("account_id").alias("account"), "country")
    span = legs(tx).groupBy("account").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    label = F.when(F.col("country").isin(*black), "FATF_BLACKLIST").otherwise("HIGH_RISK")
    return risky.join(span, "account", "left").select(
        "account", F.lit("CORRIDOR_001").alias("rule_id"), F.lit(1).alias("severity"), "country", label.alias("label"),
        F.coalesce("a", epoch).alias("window_start"), F.coalesce("z", epoch).alias("window_end"),
    )


def all_rules(tx: DataFrame, profiles: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """account, ord, rule_id, severity, window_start, window_end in the fixed rule order, for all accounts at once.

    The legs, cut to each account's last transactions if t.last says so, are written once and read by every rule.
    """
    w = written(account_window(tx, t.last), "legs")
    parts = [structuring(w, t), passthrough(w, t), fan(w, "o", t), fan(w, "i", t)] + ([corridor(profiles, tx)] if profiles is not None else [])
    rows = [p.select("account", F.lit(i + 1).alias("ord"), "rule_id", "severity", "window_start", "window_end") for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def recent_ids(tx: DataFrame, n: int = 5) -> DataFrame:
    """account, txn_ids: the last n rows of each account in file order, as text, ascending."""
    order = Window.partitionBy("account").orderBy(F.desc("row_nr"))
    one = legs(tx).select("account", "row_nr").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return one.groupBy("account").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_nr")), lambda x: x.cast("string")), ";").alias("txn_ids"))
