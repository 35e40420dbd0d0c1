"""Every stage of the pipeline against a plain version, on a table with copies, passages, nulls, repeated rows and clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparktriage.llm import pieces, quality
from tests_llm_plain import covered, plain_components

SCHEMA = "doc_id long, text string, lang string, n_chars int, pieces string, ranges int, bad string, quality_score double, key long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the rows of documents."""
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage, item = line(70), line(25)
    texts = [None, "", "  ", "Fine."]
    for i in range(60):
        t = line(rng.randrange(20, 120))
        t = f"{t} {passage} {line(9)}" if i % 5 == 0 else f"{t} {' '.join(item.split()[4:17]).upper()} {line(5)}" if i % 7 == 0 else t
        texts += [t] + [t.replace(t.split()[3], "other", 1)] * (i % 6 == 1)
    texts += ["!!! ### " * 40 + line(3) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None, len(t or ""), "p", i, "b", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[12], "en", 1, "p", 1, "b", 0.5, 7), (9, texts[20], "en", 1, "p", 1, "b", 0.5, 7)]
    at = str(tmp_path_factory.mktemp("corpus"))
    labels = [(i, int(not (t or "").startswith("!!!")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0), (10_000, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def holds(value, op, cut):
    return value <= cut if op == "<=" else value > cut


def test_quality_stage(spark, corpus):
    at, rows = corpus
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    stat = docs.select("doc_id", "text", *[c.cast("double").alias(f"s_{k}") for k, c in quality.statistics(F.col("text")).items()]).collect()
    keep = []
    for r in stat:
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(holds(r[f"s_{n}"], op, cut) for n, op, cut in rule))
        if 1 / (1 + np.exp(-z)) >= 0.3:
            keep.append((r.doc_id, r.text))
    out = corpus_pipeline.quality(spark, docs, at)
    assert out.columns == docs.columns
    show = lambda xs: sorted(map(repr, xs))
    assert show((r.doc_id, r.text) for r in out.collect()) == show(keep)
    assert {i for i, t in keep if (t or "").startswith("!!!")} == set() and len(keep) > 60


def test_near_duplicates_stage(spark, corpus):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, at)
    least, best = plain_components([r[1] for r in rows]), {}
    for r, root in zip(rows, least, strict=True):
        best[root] = min(best.get(root, (True, 0, "")), (r[0] is None, -1 if r[0] is None else r[0], "")) if root in best else (r[0] is None, -1 if r[0] is None else r[0], "")
    got = sorted((r.doc_id is None, -1 if r.doc_id is None else r.doc_id) for r in out.collect())
    assert got == sorted(b[:2] for b in best.values()) and out.columns == docs.columns


def test_repeated_passages_stage(spark, corpus):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    marks, want = covered([r[1] for r in rows]), []
    for r, m in zip(rows, marks, strict=True):
        raw = (r[1] or "").encode()
        for a, z in ((a, z) for a, z in zip(np.flatnonzero(np.diff(np.r_[0, m.astype(int)]) == 1), np.flatnonzero(np.diff(np.r_[m.astype(int), 0]) == -1) + 1, strict=True)):
            while a < z and raw[a] & 0xC0 == 0x80:
                m[a] = False
                a += 1
            while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                z -= 1
                m[z] = False
        text = None if r[1] is None else bytes(b for b, gone in zip(raw, m, strict=True) if not gone).decode()
        want.append((r[0], text, r[3] if text is None else len(text)))
    out = corpus_pipeline.repeated_passages(spark, docs, at)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_chars) for r in out.collect()))) == sorted(map(repr, want))


def test_decontaminated_stage(spark, corpus):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    item = words(spark.read.parquet(f"{at}/benchmark.parquet").where("item_id = 1").first().text)
    held = lambda t: any(f" {' '.join(item[k : k + 10])} " in f" {' '.join(words(t))} " for k in range(len(item) - 9))
    out = corpus_pipeline.decontaminated(spark, docs, at)
    want = [(r[0], r[1]) for r in rows if not held(r[1])]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want)) and 0 < len(rows) - len(want) < 30
    assert out.columns == docs.columns


def test_pieces_stage(spark, corpus):
    at, rows = corpus
    out = corpus_pipeline.pieces(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    assert out.columns == ["doc_id", "n_pieces", "pieces"] and all(r.n_pieces == len(r.pieces) for r in out.collect())
    back = pieces.decode_documents(out)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(repr, ((r[0], r[1] or "") for r in rows)))


def test_stages_of_an_empty_table(spark, corpus):
    at, _ = corpus
    none = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0, name


def test_run(spark, corpus):
    at, rows = corpus
    kept = corpus_pipeline.run(spark, at)
    assert 0 < kept.count() < len(rows) and kept.columns == ["doc_id", "n_pieces", "pieces"]
