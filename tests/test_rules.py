"""Rules against a two-pointer loop on random data with many ties, and the boundary cases."""

import random
from datetime import datetime, timedelta

from sparktriage.operators import rules

BASE = datetime(2022, 1, 1)
SCHEMA = "row_nr long, timestamp timestamp_ntz, from_account string, to_account string, amount_paid double, amount_received double, is_laundering int"


def frame(spark, rows):
    return spark.createDataFrame([(i, BASE + timedelta(seconds=s), f, t, float(p), float(r), 0) for i, (s, f, t, p, r) in enumerate(rows)], SCHEMA)


def loop(rows, account):
    """First firings (end row) of each rule for one account, by two pointers."""
    own = sorted(((s, i, f, t, p, r) for i, (s, f, t, p, r) in enumerate(rows) if account in (f, t)))
    out = {}
    band = [x for x in own if x[2] == account and 8000 <= x[4] < 9900]
    for k, x in enumerate(band):
        n = sum(x[0] - y[0] <= 86400 for y in band[: k + 1])
        if n >= 3:
            out["STRUCT_001"] = (x[1], n)
            break
    for name, mine, other in (("FAN_OUT_001", 2, 3), ("FAN_IN_001", 3, 2)):
        legs = [x for x in own if x[mine] == account]
        for k, x in enumerate(legs):
            ids = {y[other] for y in legs[: k + 1] if x[0] - y[0] <= 86400}
            if len(ids) >= 5:
                out[name] = (x[1], len(ids))
                break
    for x in own:
        if x[3] == account and x[5] > 0:
            after = [y for y in own if y[2] == account and 0 < y[0] - x[0] < 86400]
            if after and sum(y[4] for y in after) / x[5] >= 0.8:
                out["PASSTHROUGH_001"] = (x[1], len(after))
                break
    return out


def test_rules_match_the_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(0, 96) * 3600, f"A{rng.randrange(25)}", f"A{rng.randrange(25)}", rng.choice([8000, 8950, 9900, 500, 3000]), rng.choice([0, 1000, 8000])) for _ in range(700)]
    w = rules.account_window(frame(spark, rows))
    stamp = {i: BASE + timedelta(seconds=r[0]) for i, r in enumerate(rows)}
    got = {}
    for r in rules.structuring(w).collect():
        got[r.account, r.rule_id] = (r.window_end, r.txn_count)
    for side in "oi":
        for r in rules.fan(w, side).collect():
            got[r.account, r.rule_id] = (r.window_end, r.n_counterparties)
    for r in rules.passthrough(w).collect():
        got[r.account, r.rule_id] = (r.window_start, r.n_outbound)
    want = {(f"A{a}", rule): (stamp[i], n) for a in range(25) for rule, (i, n) in loop(rows, f"A{a}").items()}
    assert got == want


def test_boundaries(spark):
    day = 86400
    fire = lambda rows: {(r.account, r.rule_id) for r in rules.all_rules(frame(spark, rows)).collect()}
    assert ("S", "STRUCT_001") in fire([(0, "S", "x", 8950, 0), (3600, "S", "y", 8950, 0), (day, "S", "z", 8950, 0)])
    assert ("S", "STRUCT_001") not in fire([(0, "S", "x", 9900, 0), (3600, "S", "y", 9900, 0), (day, "S", "z", 9900, 0)])
    assert ("S", "STRUCT_001") not in fire([(0, "S", "x", 8950, 0), (3600, "S", "y", 8950, 0), (day + 1, "S", "z", 8950, 0)])
    assert ("M", "PASSTHROUGH_001") not in fire([(0, "a", "M", 10000, 10000), (day, "M", "b", 9000, 9000)])
    assert ("M", "PASSTHROUGH_001") in fire([(0, "a", "M", 10000, 10000), (day - 1, "M", "b", 9000, 9000)])
    assert ("M", "PASSTHROUGH_001") not in fire([(0, "a", "M", 10000, 10000), (60, "M", "b", 7900, 7900)])
    assert ("F", "FAN_OUT_001") in fire([(i * 60, "F", f"c{i}", 1, 1) for i in range(5)])
    assert ("F", "FAN_OUT_001") not in fire([(i * 60, "F", f"c{i % 4}", 1, 1) for i in range(9)])


def test_window_keeps_whole_transactions(spark):
    rows = [(i, "H", "H" if i % 2 else "b", 1, 1) for i in range(10)]
    kept = rules.account_window(frame(spark, rows), 3).where("account = 'H'").select("row_nr").distinct()
    assert {r.row_nr for r in kept.collect()} == {7, 8, 9}


def test_a_hub(spark):
    """One account with 100,000 legs: the cut and the rules finish, and give what a list of its first days gives."""
    n = 100_000
    tx = spark.range(n).selectExpr(
        "id AS row_nr", "timestamp_ntz'2022-01-01' + make_dt_interval(0, 0, 0, CAST(id AS DECIMAL(18, 6))) AS timestamp", "'HUB' AS from_account", "concat('c', id % 700) AS to_account",
        "1.0D AS amount_paid", "1.0D AS amount_received", "0 AS is_laundering",
    )
    w = rules.account_window(tx)
    assert w.where("account = 'HUB'").count() == 10_000
    fired = rules.fan(w, "o").collect()
    assert [(r.account, r.n_counterparties, r.n_rows, r.window_end) for r in fired] == [("HUB", 5, 5, BASE + timedelta(seconds=n - 10_000 + 4))]
