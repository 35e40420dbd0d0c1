"""Queries of the subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from sparktriage.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
