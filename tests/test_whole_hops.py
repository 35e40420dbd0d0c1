"""Whole two-hop lists, beyond the first 50 ids, against plain sets and against the SQL without its cut."""

import random

import pytest
from test_oracles import SF, duck, plain  # noqa: F401

from sparktriage.operators import graph, wholehops
from sparktriage.plans.catalog import ORACLES, QUERIES


def graph_of(seed):
    rng = random.Random(seed)
    rows = [(f"U{rng.randrange(3000):04d}", f"H{int(rng.paretovariate(0.7)) % 9}") for _ in range(4000)] + [(f"U{rng.randrange(3000):04d}", f"U{rng.randrange(3000):04d}") for _ in range(800)]
    rows += [("Y0", f"Y{i}") for i in range(80)] + [("S", "S"), ("é", "U0001"), ("\U0001f600", "é"), ("", "é"), ("H0", "H1")]
    near = {}
    for x, y in rows:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    return rows, {a: sorted({c for b in near[a] for c in near[b]} - near[a] - {a}, key=str.encode) for a in near}


@pytest.mark.parametrize("small", [False, True])
def test_whole_lists_by_plain_sets(spark, monkeypatch, small):
    """Lists of some thousands; small: many blocks, tiles, spans, calls and batches, sets as bits and as places."""
    if small:
        sizes = wholehops.Sizes(256, 16, 32, 500, 40, 3000)
        monkeypatch.setattr(graph, "with_hop2", lambda rows, e, sep: wholehops.with_hop2(rows, e, sep, sizes))
    rows, far = graph_of(1)
    asked = [(a,) for a in sorted(far)[::3] + ["H0", "H1", "Y0", "S", "none", "é", ""]] + [(None,)]
    tx, accounts = spark.createDataFrame(rows, "from_account string, to_account string"), spark.createDataFrame(asked, "account_id string")
    none = spark.createDataFrame([], "account_id string, name string, country string, kyc_risk string"), spark.createDataFrame([("S", "X")], "account_id string, label string")
    got = graph.entity_chain(tx, accounts, *none, most=None).collect()
    assert len(got) == len(set(asked)) and {r.account_id: r.hop2 for r in got} == {a: far.get(a, []) for (a,) in asked}
    assert max(len(r.hop2) for r in got) > 2000 and [r.pattern_label for r in got if r.account_id == "S"] == ["X"]


def test_whole_rows_by_hop2(spark):
    rows = [("HUB", f"R{i}") for i in range(5)] + [(f"R{i}", f"L{i}{j:02d}") for i in range(5) for j in range(15)]
    tx = spark.createDataFrame(rows, "from_account string, to_account string")
    far = graph.hop2(graph.edges(tx), spark.createDataFrame([("HUB",)], "account_id string"), None)
    assert sorted(tuple(r) for r in far.collect()) == sorted(("HUB", t) for _, t in rows[5:])


def test_no_edges(spark):
    tx = spark.createDataFrame([("A", "A")], "from_account string, to_account string")
    assert graph.hop2(graph.edges(tx), spark.createDataFrame([("A",)], "account_id string"), None).collect() == []


def test_first_fifty_are_the_registered_ones(spark, duck):  # noqa: F811
    whole, first = ({r.account_id: r.hop2.split(",") for r in QUERIES[q](spark, SF).collect()} for q in ("entity_chain_whole", "entity_chain"))
    assert {a: h[:50] for a, h in whole.items()} == first and "k <= 50" in ORACLES["entity_chain"] and "k <= 50" not in ORACLES["entity_chain_whole"]
