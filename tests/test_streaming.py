"""The stateful stream rules against the batch rules, on the same rows in any order within the watermark."""

import json
import random
from datetime import datetime, timedelta

import pytest

from sparktriage.operators import rules
from sparktriage.sources.transactions import legs
from sparktriage.streaming.stateful import streaming_rules

SCHEMA = "row_nr long, timestamp timestamp_ntz, from_account string, to_account string, amount_paid double, amount_received double"


def transactions(seed, n=260):
    rng, t0, out = random.Random(seed), datetime(2022, 1, 1), []
    for k in range(n):
        at = t0 + timedelta(minutes=rng.choice([30, 60, 97]) * k, seconds=rng.choice([0, 0, 1]))
        a, b = rng.choice("ABCDEFGH"), rng.choice("ABCDEFGHIJ")
        paid = rng.choice([8000.0, 9899.99, 9900.0, 500.0, 120.5, 10_000.0])
        out.append({"row_nr": k, "timestamp": at.isoformat(), "from_account": a, "to_account": b, "amount_paid": paid, "amount_received": paid})
    # a day to the second: inside for structuring, outside for pass-through
    for k, (h, s) in enumerate([(0, 0), (12, 0), (24, 0), (24, 1)]):
        at = datetime(2022, 1, 2) + timedelta(hours=h, seconds=s)
        out.append({"row_nr": 1000 + k, "timestamp": at.isoformat(), "from_account": "EDGE" if k else "X", "to_account": "EDGE" if not k else f"y{k}", "amount_paid": 8500.0, "amount_received": 8500.0})
    return out


def shuffled(rng, rows, within):
    """Rows in batches whose order is disturbed by less than the watermark's delay."""
    rows = sorted(rows, key=lambda r: datetime.fromisoformat(r["timestamp"]) + timedelta(seconds=rng.uniform(0, within.total_seconds())))
    return [rows[i : i + 60] for i in range(0, len(rows), 60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rows = transactions(seed)
    (tmp_path / "in").mkdir()
    end = [{"row_nr": 9000 + k, "timestamp": (datetime(2023, 1, 1) + timedelta(days=3 * k)).isoformat(), "from_account": "END", "to_account": "END2", "amount_paid": 1.0, "amount_received": 1.0} for k in range(2)]
    batches = [*shuffled(random.Random(seed), rows, timedelta(hours=11)), [end[0]], [end[1]]]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streaming_rules(stream, "12 hours").writeStream.outputMode("append").format("memory").queryName(f"rules{seed}").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        for k, batch in enumerate(batches):
            (tmp_path / "in" / f"{k:03}.json").write_text("\n".join(map(json.dumps, batch)))
            q.processAllAvailable()
        late = [r | {"from_account": "LATE", "amount_paid": 8500.0} for r in batches[0][:5]]  # behind the watermark: Spark drops them
        (tmp_path / "in" / "zzz.json").write_text("\n".join(map(json.dumps, late)))
        q.processAllAvailable()
        (tmp_path / "in" / "zzz.json").unlink()
    finally:
        q.stop()
    got = sorted((r.account, r.rule_id, r.n, r.window_start, r.window_end, r.amount, r.total, r.ratio) for r in spark.table(f"rules{seed}").collect())
    tx = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    window = legs(tx).where("account is not null")
    want = [(r.account, r.rule_id, r.txn_count, r.window_start, r.window_end, None, None, None) for r in rules.structuring(window).collect()]
    want += [(r.account, r.rule_id, r.n_outbound, r.window_start, r.window_end, r.inbound_amount, r.outbound_sum, r.ratio) for r in rules.passthrough(window).collect()]
    assert got == sorted(want) and len(want) > 6
    assert "EDGE" in {a for a, rule, *_ in got if rule == "STRUCT_001"}
