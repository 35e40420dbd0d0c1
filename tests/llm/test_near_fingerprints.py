"""The stage near_duplicates takes candidates from SimHash fingerprints, and whole sets decide on them."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from sparktriage.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def test_stage_uses_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    texts = []
    for _ in range(12):  # a long text and one with another last word: few bits apart
        t = line(400)
        texts += [t, t.rsplit(" ", 1)[0] + " end"]
    texts += ["na " * 900 + line(150) for _ in range(5)]  # one fingerprint, other sets
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= similar.RADIUS}
    assert {(k + 1, k) for k in range(0, 24, 2)} & close and (28, 24) in close
    seen, real = [], similar.proposed_pairs

    def spy(sketch, maps, radius, kind):
        out = real(sketch, maps, radius, kind)
        at = {r.node: r.doc_id for r in sketch.select("node", "doc_id").collect()}
        seen.extend(tuple(sorted((at[r.a], at[r.b]), reverse=True)) for r in out.collect())
        return out

    monkeypatch.setattr(similar, "proposed_pairs", spy)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").orderBy(F.col("doc_id")).collect()
    assert set(seen) == {(i, j) for i, j in close if i < 24}
    assert [r.doc_id for r in kept] == [*range(0, 24, 2), *range(24, 29)]
