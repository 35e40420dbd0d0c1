"""Operators with an exact answer against plain versions on small hostile tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests_llm_plain import covered

from sparktriage.llm import bpe, chat, decontaminate, mixcoder, mtree, pieces, simhash, suffix_dedup, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, out = line(80), [None, "", "   ", "a", "The end."]
    for i in range(30):
        t = line(rng.randrange(1, 120))
        out.append(f"{t} {shared} {line(20)}" if i % 4 == 0 else t)
    return out + [out[9], out[9], out[9] + " more", "la la " * 400, line(6000), out[20].upper()]


def test_decontamination(spark, texts):
    words = lambda t: re.findall(decontaminate.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, " ".join(words(texts[12])[:15])), (2, "the END"), (3, None), (4, ""), (11, " ".join(words(texts[12])[:15])), (5, "la la la la la la la la la la la")]
    got = {r.doc_id: r for r in decontaminate.op1_decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            b = words(x)
            for win in {tuple(b[k : k + 10]) for k in range(max(1, len(b) - 9))} if b else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize(("group", "levels"), [(20_000, 3), (1, 2), (1, 0)])
def test_suffix_dedup(spark, texts, group, levels):
    """group 1 splits every group of edges by further anchors, and counts what is left string by string; levels 0 counts all."""
    d = docs(spark, texts)
    found = suffix_dedup.repeated_ranges(d, group=group, levels=levels).collect()
    marks = covered(texts)
    by_hash = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    for i, t in enumerate(texts):
        got = np.zeros(len(marks[i]), bool)
        for r in found:
            if r.doc_id == i and r.hash == by_hash[i]:
                got[r.start : r.stop] = True
        assert (got == marks[i]).all(), i
    if group > 1:
        for r in suffix_dedup.op2_suffix_dedup(d).collect():
            b, m = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8), marks[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), m.sum(), (np.diff(np.r_[0, m.astype(int)]) == 1).sum())
            assert r.kept_sha256 == hashlib.sha256(b[~m].tobytes()).hexdigest()
        clean = suffix_dedup.remove_repeats(d)
        assert clean.columns == d.columns and clean.count() == len(texts)


def test_equal_digests_of_other_bytes(texts, monkeypatch):
    """Spans of one batch with colliding digests are parted by their bytes."""
    anchor = np.zeros(6, np.uint64)
    same, own = np.zeros((6, 2), np.uint64), [b"x", b"y", b"x", b"z", b"y", b"x"]
    order, again = suffix_dedup._copies(anchor, same, own.__getitem__)
    assert all((own[order[k]] == own[order[k - 1]]) == again[k] for k in range(1, 6)) and again.sum() == 3
    monkeypatch.setattr(suffix_dedup, "_DIGEST", lambda x: bytes(16))
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "hash": i, "text": t} for i, t in enumerate(texts)], pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string())]))
    (out,) = suffix_dedup._spans(200, 40)(iter([batch]))
    held, told = {}, 0
    for r in out.to_pylist():
        s, n = r["place"] >> 16, (r["place"] >> 8 & 255) + 200
        own = (texts[r["doc_id"]] or "").encode()[s : s + n]
        told += r["kind"] == 1
        if r["kind"] != 1:
            held.setdefault((r["anchor"], r["same"], r["other"]), set()).add(own)
    assert all(len(x) == 1 for x in held.values()) and told > 5


def test_parts_of_a_large_batch():
    """Rows of 5.4 MB in one batch: equal spans get equal anchors and places."""
    rng = random.Random(4)
    own = [rng.randbytes(360) for _ in range(500)]
    rows = [own[i % 500] for i in range(15_000)]
    names = ["anchor", "doc_id", "hash", "place", "kind", "bytes"]
    ids = pa.array(range(15_000), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 15_000, pa.int64()), ids, ids, pa.array([0] * 15_000, pa.int64()), pa.array([3] * 15_000, pa.int32()), pa.array(rows, pa.binary())], names)
    found = {}
    for out in suffix_dedup._parted(200, 40, 5)(iter([batch])):
        for r in out.to_pylist():
            found.setdefault(r["doc_id"], []).append((r["anchor"], r["place"], r["bytes"]))
    assert len(found) == 15_000 and all(found[i] == found[i % 500] for i in found)
    assert all(p >= 0 and own[i][p >> 16 :].startswith(b) for i in range(500) for _, p, b in found[i])
    with pytest.raises(ValueError, match="bytes at once"):
        suffix_dedup.anchored_spans(np.zeros((1 << 22) + 1, np.uint8), np.array([(1 << 22) + 1]), 200, 40)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.op2_suffix_dedup(docs(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(spark, texts, block):
    """block 3 splits every bucket into pairs of sub-blocks."""
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    fps += [fps[10] ^ 1, fps[10] ^ 3, fps[10] ^ 7, fps[10] ^ 31]
    least = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            least[i] = min([least[i], *(least[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    units = simhash.candidate_units(spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long"), block=block).repartition(3, "combo", "key", "lo", "hi").sortWithinPartitions("combo", "key", "lo", "hi")
    edges = [(r.a, r.b) for r in units.mapInArrow(simhash._linker(2), "a long, b long").collect()]
    root = {f: f for f in map(signed, fps)}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    same = lambda xs: {tuple(i for i, y in enumerate(xs) if y == x) for x in xs}
    assert same([root[signed(f)] for f in fps]) == same(least)
    if block > 3:
        n = len(texts)
        alone = list(range(n))
        for _ in range(n):
            for i in range(n):
                alone[i] = min([alone[i], *(alone[j] for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= 2)])
        got = {r.doc_id: r for r in simhash.op8_simhash(docs(spark, texts)).collect()}
        assert [(got[i].fingerprint, got[i].component_id) for i in range(n)] == [(f"{fps[i]:016x}", alone[i]) for i in range(n)]
        assert {r.doc_id for r in simhash.keep_representatives(docs(spark, texts)).collect()} == set(alone)


def test_bit_sliced_counters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in rng.choice(64, k % 7, replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    for radius in (0, 1, 2, 3, 5):
        d = simhash.planes(a ^ b)
        near = simhash.close_lanes(d.__getitem__, d.shape[1], radius)
        assert (simhash._lanes(near)[:300] == (np.bitwise_count(a ^ b) <= radius)).all()


def test_pieces(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    odd = texts + [" a  b\nc▁d", "日本語 \t 🙂", "a" * 300]
    plain = pieces.encode_documents(docs(spark, odd), dropout=0.0).collect()
    assert all(r.pieces == sp.encode(odd[r.doc_id] or "") for r in plain if "▁" not in (odd[r.doc_id] or ""))
    a, b, c = ({r.doc_id: r.pieces for r in pieces.encode_documents(docs(spark, odd), dropout=0.3, seed=s).collect()} for s in (1, 1, 2))
    assert a == b != c
    back = pieces.decode_documents(pieces.encode_documents(docs(spark, odd), dropout=0.3))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(odd)}
    assert all(r.lossless for r in pieces.op6_pieces(docs(spark, odd)).collect())


def test_each_occurrence_is_segmented_on_its_own():
    """Occurrences equal the agenda run under their own key, and a word has more segmentations than a few shared keys give."""
    path = public_tokenizers.path(pieces.MODEL)
    enc, unit, n = pieces.Encoder(path, 0.1, 1), " international", 3000
    far = " " + "abcdefgh" * 9
    raw = (unit * n)[1:].encode() + far.encode()
    v, seen = pieces.vocabulary(path), set()
    for doc in (5, 6):
        ids = enc.encode([raw], [doc])[0].tolist()
        assert enc.decode(np.array(ids)) == raw
        at = 0
        for k in range(n + 1):
            u = unit if k < n else far
            key = pieces.occurrence_keys(np.array([doc], np.uint64), np.array([k]), 1)
            want = v.spelled(bpe.agenda_encode(v, v.symbols([u])[0].tolist(), lambda p, r, key=key: pieces.skipped(key, p, r, 0.1)))
            assert ids[at : at + len(want)] == want
            at += len(want)
            seen.add((u, tuple(want)))
        assert at == len(ids)
    assert len(seen) > 20


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 10_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.5, rng.integers(0, 49408, n), 7).astype(np.uint32)
    data = mixcoder.encode(x, 49408)
    assert (mixcoder.decode(data) == x).all()
    if n > 2000:
        with pytest.raises(ValueError):
            mixcoder.decode(data + bytes(4))
        hurt = bytearray(data)
        hurt[len(data) // 2] ^= 255
        with pytest.raises(ValueError):
            mixcoder.decode(bytes(hurt))


def test_long_units():
    """Letters without blanks: the agenda of long units gives what the definition gives, and skips one by one as it does all at once."""
    rng = np.random.default_rng(3)
    key, place, rank = np.array([0xDEADBEEF], np.uint32), rng.integers(0, 1 << 20, 5000), rng.integers(0, 1 << 15, 5000)
    own = pieces.UnitSkips(key, 0.3)
    assert [own.one(int(p), int(r)) for p, r in zip(place, rank, strict=True)] == own(place, rank).tolist() and 0.25 < own(place, rank).mean() < 0.35
    enc = pieces.Encoder(public_tokenizers.path(pieces.MODEL), 0.2, 1)
    letters = "".join(rng.choice(list("etaoinshrdluna\u00e9\u65e5"), 700).tolist())
    for text in (letters, "a" * 333, "ab" * 90, "https://example.org/" + "x9-_" * 60, "=" * 49):
        ids = enc.encode([text.encode()], [4])[0].tolist()
        skip = pieces.UnitSkips(pieces.occurrence_keys(np.array([4], np.uint64), np.array([0]), 1), 0.2)
        assert ids == plain_dropout(enc.v, enc.v.symbols([" " + text])[0].tolist(), skip.one)
        assert enc.decode(np.array(ids)) == text.encode()


def plain_dropout(v, symbols, skip):
    """Merge-dropout by the definition: the best pair of neighbours that is not skipped, leftmost first, until there is none."""
    row = [(s, k) for k, s in enumerate(symbols)]
    table = {(int(e) >> 40, int(e) >> 20 & 0xFFFFF): int(e) & 0xFFFFF for e in v.entries if e >= 0}
    while True:
        best = min(((table[a, b], k) for k, ((a, i), (b, _)) in enumerate(zip(row, row[1:], strict=False)) if (a, b) in table and not skip(i, table[a, b])), default=None)
        if best is None:
            return v.spelled([s for s, _ in row])
        row[best[1] : best[1] + 2] = [(int(v.piece[best[0]]), row[best[1]][1])]


def test_dropout_by_its_definition():
    """Hostile units, many times: the batched form gives what the definition gives, and skips about as many candidates as asked for."""
    enc = pieces.Encoder(public_tokenizers.path(pieces.MODEL), 0.25, 3)
    units = [" the", " international", " aaaaaaaaaaaaaaaaa", " ", "   ", "\n", " \u00e9t\u00e9s", " \u65e5\u672c\u8a9e", " b\u2581c", " " + "na" * 12, " " + "x1y2" * 14, " ababab"]
    raw = ("".join(units) * 12)[1:].encode()
    ids, at = enc.encode([raw], [77])[0].tolist(), 0
    cut = [u.decode() for u in pieces._UNIT.findall(b" " + raw)]
    for k, u in enumerate(cut):
        key = pieces.occurrence_keys(np.array([77], np.uint64), np.array([k]), 3)
        want = plain_dropout(enc.v, enc.v.symbols([u])[0].tolist(), lambda i, r, key=key: bool(pieces.skipped(key, np.array([i]), np.array([r]), 0.25)[0]))
        assert ids[at : at + len(want)] == want, u
        at += len(want)
    assert at == len(ids) and enc.decode(np.array(ids)) == raw
    rate = pieces.skipped(np.arange(100_000).astype(np.uint32), np.arange(100_000) % 9, np.arange(100_000) % 77, 0.1).mean()
    assert abs(rate - 0.1) < 0.005


def test_coder_is_smaller_than_order0():
    """Ids of whole documents in fewer bits than any model of single ids needs, and than zlib makes of them."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    words = tokenfile.word_tokens(public_tokenizers.path(tokenfile.MODEL))
    ids = np.concatenate(words.encode([(t or "").encode() for t in texts])).astype(np.uint32)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * len(mixcoder.encode(ids, words.vocab)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() - 0.5 < 8.5
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 1


@pytest.mark.parametrize(("vocab", "n"), [(1, 3000), (257, 5000), (70_000, 9000), (262_144, 2049)])
def test_coder_for_any_vocabulary(vocab, n):
    rng = np.random.default_rng(vocab)
    even, runs = rng.integers(0, vocab, n), np.repeat(rng.integers(0, vocab, n // 50 + 1), 50)[:n]
    for x in (even, runs, np.full(n, vocab - 1), np.minimum(rng.zipf(1.3, n), vocab) - 1):
        x = x.astype(np.uint32)
        assert (mixcoder.decode(mixcoder.encode(x, vocab)) == x).all()


def test_token_files_cost_less_than_the_library():
    """F1 of r03: cutting, coding and decoding together take less CPU than the library's own cutting alone (1.9 times as much before, 0.5 now), in under 7 bits an id (7.8 before)."""
    import time

    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    words, took = tokenfile.WordTokens(public_tokenizers.path(tokenfile.MODEL)), [time.process_time()]
    lib = [e.ids for e in words.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    took.append(time.process_time())
    ids = np.concatenate(words.encode(texts)).astype(np.uint32)
    data = mixcoder.encode(ids, words.vocab)
    back = mixcoder.decode(data)
    took.append(time.process_time())
    assert (back == ids).all() and ids.tolist() == [x for own in lib for x in own]
    assert 8 * len(data) / len(ids) < 7
    assert took[2] - took[1] < took[1] - took[0]


def test_coder_lists():
    """Contexts with more followers than a table lists, more ids than 32-bit keys of pairs allow, runs that only pairs foretell; damage anywhere is an error."""
    rng = np.random.default_rng(5)
    many = np.zeros(80_000, np.uint32)
    many[::2] = np.tile(np.arange(1, 20_001), 2)
    wide = rng.permutation(np.repeat(np.arange(70_000), 2)).astype(np.uint32)
    word = [rng.integers(0, 900, rng.integers(1, 7)) for _ in range(400)]
    text = np.concatenate([word[k] for k in np.minimum(rng.zipf(1.4, 30_000), 400) - 1]).astype(np.uint32)
    for x, vocab in ((many, 20_001), (wide, 70_000), (text, 900), (np.r_[text, text[::-1]], 900)):
        assert (mixcoder.decode(mixcoder.encode(x, vocab)) == x).all()
    tables, place, entry = mixcoder.Tables.of(text[: len(text) // 100 * 100], 100)
    assert len(tables.pairs) > 20 and (entry >= 0).all() and (tables.ids[place] == text[: len(place)]).all()
    data = mixcoder.encode(text, 900)
    assert 8 * len(data) / len(text) < 4
    for k in range(4, len(data), 97):
        hurt = bytearray(data)
        hurt[k] ^= 1 << k % 8
        try:
            same = (mixcoder.decode(bytes(hurt)) == text).all()
        except ValueError:
            continue
        assert same, k  # a bit after the end of a block's last id


def test_words_of_other_letters_as_the_library_has_them():
    """Words near the edge of what is cut here: capitals, letters that change their length, signs among letters, special strings, marks, blanks."""
    rng = random.Random(11)
    marks = ["a", "T", "\u00e9", "\u00c9", "\u00df", "\u0130", "\u0131", "\u0149", "\u017f", "\u0178", "\u00d7", "\u00f7", "\u0170", "\u0180", "7", "'", "'s", "'LL", "<", "|", "<|", ">", ".", "\u0301", "\u00a0", "\u00ad", "\u65e5", "\U0001f600", "\x7f", "\x00", "\x1c", " ", " ", "\n", "\t ", "\x0b"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(3000)] + ["", " ", "<|endoftext|>", "x<|endoftext|> \u00e9<", "| a", "\u00c9" * 100, "ab" * 400]
    words = tokenfile.WordTokens(public_tokenizers.path(tokenfile.MODEL))
    got = words.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, texts):
    odd = texts + ["It's <|endoftext|> 12 É é", "<|ENDOFTEXT|>"]
    tok = Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))
    got = {r.doc_id: r for r in tokenfile.op10_token_ids(docs(spark, odd)).collect()}
    start = 0
    for i, t in enumerate(odd):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    small = tokenfile.read_ids(tokenfile.write_ids(docs(spark, odd), segment=50)).where("doc_id = 9").first()
    assert small.ids == [*tok.encode(odd[9], add_special_tokens=False).ids, 1]


def test_token_files_of_decomposed_capitals(spark):
    """Only the small letter of these has a composed form, so lower-casing before NFC gives other ids."""
    odd = ["x a\u0591\u0301 B\u0591\u0301 'LL don't I'M caf\u00e9s' \u0130I 3\u00b2x a\u00a0b\u2003c\x1cd \x85e 'S\u00e9", "ab\x00c d\x7f<|x|> <| y", "T\u0308a", "H\u0331 x", "J\u030c x", "W\u030a", "Y\u030a B", "E\u0301 X"]
    tok = Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))
    got = {r.doc_id: r for r in tokenfile.op10_token_ids(docs(spark, odd)).collect()}
    start = 0
    for i, t in enumerate(odd):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_other_tokenizers_and_hot_ids(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert tokenfile.cut_here(public_tokenizers.path(tokenfile.MODEL)) and not tokenfile.cut_here(path)
    some = [*texts[:9], "It's  A B\n C", "x <|endoftext|>"]
    for r in tokenfile.read_ids(tokenfile.write_ids(docs(spark, some), path)).collect():
        assert r.ids == [*tok.encode(some[r.doc_id] or "", add_special_tokens=False).ids, 1]
    hot = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")).union(spark.createDataFrame([(None, f"n{k}") for k in range(500)], "doc_id int, text string"))
    files = tokenfile.write_ids(hot)
    assert files.select("part").distinct().count() > 2
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in tokenfile.op10_token_ids(hot).collect())
    assert len(got) == 4500 and [s for s, *_ in got] == [0, *np.cumsum([n for _, n, _ in got])[:-1].tolist()] and [d for *_, d in got] == [None] * 500 + [7] * 4000


@pytest.mark.parametrize("shard", [150, 20, 16_384])
def test_top_k(spark, shard):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)] + [(900 + i, [0.5] * 8) for i in range(300)]
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2250, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    v = mtree.quantised(df)
    got = {}
    for r in mtree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard=shard, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    for i in (k for k in q if k % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_chat(spark):
    hard = "a\\b \\l <|turn|> <|end|>\n </s>[INST] x [/INST] <<SYS>>"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", None), (2, 0, None, hard), (None, 0, "system", "s"), (1, 2, "a\nb", "t"), (1, 2, "a\nb", "t")]
    conv = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    made = {r.conv_id: r for r in chat.format_turns(chat.canonical_turns(conv)).collect()}
    assert chat.read_turns(made[1].formatted) == [("user", ""), ("assistant", hard), ("a\nb", "t"), ("a\nb", "t")]
    assert [chat.unescaped(made[1].formatted[s.start : s.stop]) for s in made[1].loss] == [hard]
    assert chat.read_turns(made[2].formatted) == [("", hard)]
    got = {r.conv_id: r for r in chat.op3_chat(spark, conv).collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len("</s>[INST] ok [/INST]") and None in got
    turns = chat.record_turns('{"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": null}]}')
    assert turns == [{"role": "user", "text": "q"}, {"role": "assistant", "text": ""}]
    assert chat.record_turns('{"instruction": "do", "input": "", "output": "done", "extra": 1}') == [{"role": "user", "text": "do"}, {"role": "assistant", "text": "done"}]
    assert chat.record_turns("{") == chat.record_turns(None) == chat.record_turns('{"z": 1}') == []
    typed = spark.createDataFrame([(1, "q", "r")], "conv_id long, prompt string, response string")
    assert [tuple(t) for t in chat.canonical_turns(typed).first().turns] == [("user", "q"), ("assistant", "r")]


def test_hostile_records():
    deep, lone = "[" * 100_000, '{"messages": [{"role": "user", "content": "\\ud800"}]}'
    assert chat.record_turns(deep) == chat.record_turns(lone) == chat.record_turns(None) == chat.record_turns("{") == []
    assert chat.record_turns('{"messages": [{"role": "user", "content": "hi"}]}') == [{"role": "user", "text": "hi"}]
