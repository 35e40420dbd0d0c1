"""Every operator on tables with nulls, repeated rows and ids, columns named as its own, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from sparktriage.llm import chat, mtree, simhash
from sparktriage.llm.decontaminate import drop_contaminated, op1_decontaminate
from sparktriage.llm.language import op5_language
from sparktriage.llm.pieces import decode_documents, encode_documents, op6_pieces
from sparktriage.llm.quality import op9_quality
from sparktriage.llm.simhash import op8_simhash
from sparktriage.llm.suffix_dedup import op2_suffix_dedup, remove_repeats
from sparktriage.llm.tokenfile import op10_token_ids, read_ids, write_ids
from sparktriage.llm.toxicity import op7_toxicity

OWN = "pieces fp quality_score quality_predicted row at s k w window hash score predicted component_id root node start stop ranges own_id own_hash bad key stat_ __y rows n lang_pred".split()
TEXTS = ["long words of a text that goes on " * 20, "short", None, "", "\u00e9\u00e8 \u65e5\u672c " * 3, "word " * 60_000, "short"]


@pytest.fixture(scope="module")
def hostile(spark):
    ids = [1, 2, 3, 4, 5, 6, 7]
    rows = [(i, t, "en") for i, t in zip(ids, TEXTS, strict=True)] + [(1, TEXTS[0], "en"), (None, "no id", None), (None, "no id", None), (2, "other text of an id", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.select("*", *[F.lit(7).alias(c) for c in OWN])


@pytest.fixture(scope="module")
def extra(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (2, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "short", 0), (1, "short", 0), (None, "no ID", 0), (2, None, 0)], "item_id long, text string, window int")
    return labels, items


def test_documents(hostile, extra):
    labels, items = extra
    n = hostile.count()
    runs = {
        "op1": lambda d: op1_decontaminate(d, items), "op2": op2_suffix_dedup, "op5": op5_language, "op6": op6_pieces, "op7": lambda d: op7_toxicity(d, labels),
        "op8": op8_simhash, "op9": lambda d: op9_quality(d, labels), "op10": op10_token_ids,
    }
    got = {}
    for name, run in runs.items():
        got[name] = run(hostile).collect()
        assert len(got[name]) == n, name
        assert run(hostile.where("false")).count() == 0, name
    hits = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in got["op1"]}
    assert hits[2, 1] == (1, 1) and hits[None, 2] == (2, 0)  # an item without an id has no place in the list of ids
    assert {r.doc_id for r in got["op2"] if r.n_removed} == {1, 6}
    assert all(r.lossless for r in got["op6"])
    spans = sorted((r.start, r.n_tokens) for r in got["op10"])
    assert [s for s, _ in spans] == [sum(k for _, k in spans[:i]) for i in range(n)]
    empty = {r.component_id for r in got["op8"] if r.doc_id in (3, 4)}
    assert len(empty) == 1 and min(empty) == 3


def test_stages_keep_columns(hostile, extra):
    _, items = extra
    assert drop_contaminated(hostile, items).columns == remove_repeats(hostile).columns == simhash.keep_representatives(hostile).columns == hostile.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_representatives(hostile).select("doc_id").collect()) == [(False, 1), (False, 2), (False, 2), (False, 3), (False, 5), (False, 6), (True, 0)]
    out = encode_documents(hostile)
    assert out.columns == [c for c in hostile.columns if c != "pieces"] + ["pieces"] and decode_documents(out).count() == hostile.count()
    assert read_ids(write_ids(hostile)).count() == hostile.count()


def test_vectors(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.25, 1.0]), (50, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(3).alias(c) for c in ("shard", "dim", "v", "block", "score", "rank", "query_id")])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.op4_topk(df).collect()}
    assert got[0, 1] == got[0, 2] == (7, 512 * 256 + 512 * 128) and got[0, 3][0] == 50
    assert mtree.op4_topk(df.where("false")).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, None), (None, 0, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(3).alias(c) for c in ("t", "turns", "lone", "m", "loss")])
    got = sorted(((r.conv_id is None, r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat.op3_chat(spark, df).collect()))
    assert got == [(False, -7, 2, 21), (False, 1, 3, 0), (True, 0, 1, 0), (True, 0, 1, 1)]
    assert chat.op3_chat(spark, df.where("false")).count() == 1
