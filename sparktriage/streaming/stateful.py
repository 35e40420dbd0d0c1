"""Structuring and pass-through on a stream: state by account, event-time timers, the rows of the batch rules.

Legs may come in any order within the watermark's delay. An account's legs are kept until what they can take part in is settled, a day
at most beyond the watermark: a leg's trailing day is complete once the watermark has reached it, an inbound leg's following day a day
later. One timer an account, at the next such moment, does the work; so each rule sees its legs in the order of the batch rule and the earliest firing is the
same. A rule fires once an account. When both have fired, or all legs are settled and over a day old, only that is kept.

Rows with a null account or amount take no part in the sums; legs that come later than the watermark allows are dropped by Spark. The batch rules' cut to an
account's last transactions has no place here: state is bounded by the account's legs of a day and the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import DAY, Thresholds
from ..sources.transactions import legs

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRED = "account string, rule_id string, severity int, n long, amount double, total double, ratio double, start_us long, end_us long"
_COLUMNS = [x.split(" ")[0] for x in FIRED.split(", ")]
_LEG = "us long, row_nr long, side string, amount double"

Leg = tuple[int, int, str, float]


def first_structuring(held: list[Leg], after: int, upto: int, t: Thresholds) -> tuple | None:
    """Of legs in order: the first one in (after, upto] with enough outbound amounts of the band in its trailing day, both ends included."""
    band = [x for x in held if x[2] == "o" and x[3] is not None and t.band_low <= x[3] < t.band_high]
    lo = 0
    for k, (us, *_) in enumerate(band):
        while band[lo][0] < us - DAY:
            lo += 1
        if after < us <= upto and k - lo + 1 >= t.struct_count:
            return (k - lo + 1, None, None, None, band[lo][0], us)
    return None


def first_passthrough(held: list[Leg], after: int, upto: int, t: Thresholds) -> tuple | None:
    """Of legs in order: the first inbound one in (after, upto] that outbound of at least the ratio follows within a day, both ends excluded."""
    outs = [x for x in held if x[2] == "o" and x[3] is not None]
    for us, _, side, amount in held:
        if side == "i" and after < us <= upto and amount is not None and amount > 0:
            own = [x for x in outs if us < x[0] < us + DAY]
            total = sum(x[3] for x in own)
            if own and total / amount >= t.pass_ratio:
                return (len(own), round(amount, 4), round(total, 4), round(total / amount, 4), us, own[-1][0])
    return None


class Rules(StatefulProcessor):
    def __init__(self, t: Thresholds):
        self.t = t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.legs = handle.getListState("legs", _LEG)
        self.done = handle.getValueState("done", "seen long, structuring boolean, passthrough boolean")

    def _state(self) -> tuple[int, bool, bool]:
        return tuple(self.done.get()) if self.done.exists() else (-(1 << 62), False, False)

    def _next(self, held: list[Leg], seen: int) -> None:
        """One timer: at the earliest moment after `seen` at which a leg or an inbound leg's following day is settled."""
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms if isinstance(ms, int) else ms[0])
        moments = [m for us, *_ in held for m in (us, us + DAY) if m > seen]
        if moments:
            self.handle.registerTimer(-(-min(moments) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, *fired = self._state()
        new = [(int(us), int(nr), side, None if pd.isna(amount) else float(amount)) for f in rows for us, nr, side, amount in f[["us", "row_nr", "side", "amount"]].itertuples(index=False)]
        if not all(fired):
            self.legs.appendList(new)
            self._next([*map(tuple, self.legs.get())], seen)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        seen, structuring, passthrough = self._state()
        held, out = sorted(map(tuple, self.legs.get()), key=lambda x: x[:2]), []
        if not structuring and (hit := first_structuring(held, seen, mark, self.t)):
            out.append((key[0], "STRUCT_001", 3, *hit))
            structuring = True
        if not passthrough and (hit := first_passthrough(held, seen - DAY, mark - DAY, self.t)):
            out.append((key[0], "PASSTHROUGH_001", 3, *hit))
            passthrough = True
        self.done.update((mark, structuring, passthrough))
        held = [] if structuring and passthrough else [x for x in held if x[0] > mark - DAY]
        if held:
            self.legs.put(held)
        else:
            self.legs.clear()
        self._next(held, mark)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers need, unless the session names one."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def streaming_rules(tx: DataFrame, late: str = "1 hour", t: Thresholds = Thresholds()) -> DataFrame:
    """account, rule_id, severity, n, amount, total, ratio, window_start, window_end of a stream of transactions, as each rule's first firing is settled.

    n is txn_count of structuring and n_outbound of pass-through; amount, total and ratio are the latter's.
    """
    use_state_store(tx.sparkSession)
    rows = legs(tx.withColumn("timestamp", F.col("timestamp").cast("timestamp"))).where("account is not null").withWatermark("timestamp", late)
    fired = rows.groupBy("account").transformWithStateInPandas(statefulProcessor=Rules(t), outputStructType=FIRED, outputMode="Append", timeMode="EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return fired.withColumns({"window_start": at("start_us"), "window_end": at("end_us")}).drop("start_us", "end_us")
