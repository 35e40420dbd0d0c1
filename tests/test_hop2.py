"""Two-hop lists of a dense graph, with hubs that share many neighbours: both ways to them against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from sparktriage.operators import graph


@pytest.mark.parametrize(("most", "words"), [(3, 1), (30, 1), (70, 1), (50, 4), (100, 4)])
def test_both_ways_by_plain_sets(spark, most, words):
    """Some accounts, all or none have `most` ids at two steps among the first 64 x words."""
    rng = random.Random(most)
    rows = [(f"U{rng.randrange(400):03d}", f"H{rng.randrange(12)}") for _ in range(1500)] + [(f"H{i}", f"H{i + 1}") for i in range(5)] + [(f"X{i}", f"X{i + 1}") for i in range(90)] + [("Y0", f"Y{i}") for i in range(80)]
    near = {}
    for x, y in rows:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    asked = sorted(near)[::2] + ["H3", "Y0", "none"]
    want = {(a, c) for a in asked if a in near for c in sorted({c for b in near[a] for c in near[b]} - near[a] - {a})[:most]}
    tx = spark.createDataFrame(rows, "from_account string, to_account string")
    got = [(r.account, r.cp) for r in graph.hop2(graph.edges(tx), spark.createDataFrame([(a,) for a in asked], "account_id string"), most, words).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hubs_do_not_multiply(spark, tmp_path):
    """3,000 users with 40 of 80 hubs each, 240,000 edges: no join of the plan gives many rows an edge (lists of 50 + 40 + 1 ids an edge did)."""
    tx = spark.range(3000 * 40).selectExpr("concat('U', id div 40) AS from_account", "concat('H', (id * 7 + id div 40) % 80) AS to_account")
    graph.edges(tx).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    users = e.select(F.col("account").alias("account_id")).where("account_id like 'U%'").distinct()
    far = graph.hop2(e, users)
    far.collect()
    seen, stack = [], [far._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        stack += inner + [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            seen.append(node.metrics().apply("numOutputRows").value())
    assert seen and max(seen) <= 2 * e.count()
    assert far.groupBy("account").count().where("count = 50").count() == 3000
