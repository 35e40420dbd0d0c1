"""Trained operators by held-out accuracy, and their edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparktriage.llm import common, language, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "123 !!"), (90_005, "\u00b2\u00bd"), (90_004, "word " * 30_000)], "doc_id long, text string")
    return d.unionByName(odd, allowMissingColumns=True), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality(tables):
    got = {r.doc_id: r for r in quality.op9_quality(*tables).collect()}
    pairs = [(got[r.doc_id].predicted, r.quality) for r in tables[1].collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in pairs) >= 0.9 * len(pairs)
    assert all(0 <= got[i].score <= 1 for i in (90_001, 90_002, 90_003, 90_004))
    twice = tables[0].limit(50).withColumn("quality_score", F.lit("own")).withColumn("stat_", F.lit(1))
    out = quality.score_quality(twice.union(twice), quality.RuleEnsemble(0.0))
    assert out.columns.count("quality_score") == 1 and out.count() == 100 and "stat_" in out.columns
    none = quality.op9_quality(tables[0], tables[1].where("false"))
    assert {r.score for r in none.select("score").distinct().collect()} == {0.5}


def test_language(tables):
    got = {r.doc_id: r for r in language.op5_language(tables[0]).collect()}
    pairs = [(got[r.doc_id].lang_pred, r.lang) for r in tables[0].where("lang is not null").select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    assert [got[i].lang_pred for i in (90_001, 90_002, 90_003, 90_005)] == ["und"] * 4
    assert {r.lang_pred for r in language.op5_language(tables[0].withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(i, " ".join([word() for _ in range(60)] + ["vilest"] * (i % 4 == 0)), "en" if i % 3 else None, int(i % 4 == 0)) for i in range(1200)] + [(5000, None, None, 0)]
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op7_toxicity(d, labels).collect()}
    held = [(got[i].predicted, y) for i, _, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and got[5000].predicted == 0
    few = toxicity.train_toxicity(d, labels, max_words=3000)
    assert few.emb.shape[0] < 2000 and toxicity.score_toxicity(d, few).count() == len(rows)
    empty = d.where("false")
    assert toxicity.op7_toxicity(empty, labels).count() == 0 == language.op5_language(empty.withColumn("lang", F.lit("en"))).count()
    assert all(r.predicted == 0 for r in toxicity.op7_toxicity(d.limit(50), labels.where("toxic = 0")).collect())


def test_a_long_text_takes_no_other_texts_place(spark):
    held = spark.createDataFrame([(i, bytes([i % 250, i // 250]), 30_000 if i == 0 else 100) for i in range(400)] + [(5, b"x", 64)] * 20, "doc_id long, rows binary, n long")
    got = toxicity.within_words(held, 20_000)
    n = [r.n for r in got.select("n").collect()]
    assert max(n) == 100 and 0.7 * 20_000 < sum(n) <= 20_000
    assert toxicity.within_words(held, 10**6).count() == 420


def test_samples_of_huge_tables():
    for n in (1, 20_000, 2 * 10**10, 10**15):
        assert 0.99 <= common.sample_below(20_000, n) * max(n, 20_000) / (20_000 * common.KEYS) <= 1.01 or n <= 20_000
    assert common.sample_below(20_000, 5) == common.KEYS
