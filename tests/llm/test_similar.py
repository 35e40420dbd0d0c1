"""Near copies of the pipeline against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_plain import plain_components

import corpus_pipeline
from sparktriage.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string"


@pytest.fixture(scope="module")
def near():
    rng = random.Random(5)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, shared = [None, "", " ", "One two", "one  TWO", "one two three four five six"], line(40)
    for i in range(25):
        t = line(rng.randrange(20, 200)) + (shared if i % 3 == 0 else [])
        out.append(" ".join(t))
        for edits in (1, 2, 4, 9):  # similarity on both sides of 0.8, and chains
            t = list(t)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "edited"
            out.append(" ".join(t))
    return out


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("block", "held"), [(2048, 1 << 20), (2, 1 << 20), (2048, 300)])
def test_similar_components(spark, near, block, held):
    """block 2 splits every larger bucket into pairs of sub-blocks, held 300 every group of some hundred shingles."""
    docs = spark.createDataFrame(rows(near), SCHEMA)
    got = {r.doc_id: r.root for r in similar.similar_components(docs, block=block, held=held).collect()}
    same = lambda xs: {tuple(i for i, y in enumerate(xs) if y == x) for x in set(xs)}
    assert same([got[i] for i in range(len(near))]) == same(plain_components(near))


def test_stage_keeps_one_of_each_group(spark, near):
    docs = spark.createDataFrame(rows(near), SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, near[i]) for i in sorted(set(plain_components(near)))]
    assert corpus_pipeline.near_duplicates(spark, docs.where(F.lit(False)), "").count() == 0


def test_one_row_of_repeated_rows(spark):
    """Equal rows, rows of one id with other texts, and an id of null: one row a group stays."""
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    own = [(1, a, "en"), (1, a, "en"), (1, a, "de"), (2, a, "en"), (1, b, "en"), (None, b, "en"), (3, b + " more", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t), "x") for i, t, lang in own], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text", "lang").collect()
    assert sorted(map(tuple, got)) == [(1, a, "de"), (1, b, "en")]


def test_parity_maps():
    """Maps of any two sizes lose no similar pair, and part sets of many shingles that share none."""
    rng = np.random.default_rng(3)
    own = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    sets = []
    for n in (3, 400, 510, 520, 1100, 5000, 9000):
        a = own(n)
        sets += [a, np.unique(np.r_[a[: int(n * 0.95)], own(int(n * 0.1))]), own(n)]
    links = similar.link_maps([len(x) for x in sets], [similar.parity(x) for x in sets], np.full(len(sets), 2), (4, 5))
    root = list(range(len(sets)))
    for _ in sets:
        for i, k in links:
            root[i] = root[k] = min(root[i], root[k])
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert root[i] == root[k]
            if both == 0 and len(a) > 300 and len(b) > 300:
                assert root[i] != root[k]
