"""Token counts, divergence of sources and centroid clustering against plain versions on hostile tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktriage.llm import centroids, divergence, tokencount

OWN = "n docs term total lead block member x data kind ids cluster distance size n_tokens part value".split()


def test_token_counts(spark):
    rng = random.Random(7)
    odd = "  \u0085\x1c\x1f​́٣Ⅷ½中\U0001f600᠎﻿ำᾠʰ꟏\U00010d40\U0001e4d0" + "a B7 '\n\t  !_<|"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "a\n\n b", "it's we'LL 'sx ''s", "x <|endoftext|> y<|endoftext|>", "<|endoftext", "Z" * 5000, "  \n" * 3000, "word, " * 200_000, "café naïve " * 90_000, "a b", "a b"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(3).alias(c) for c in OWN])
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: (len((t or "").encode()), len(want.encode(t or "", add_special_tokens=False).ids))
    for most in (1 << 16, 3):
        got = sorted(tuple(r) for r in tokencount.count_tokens(d, most=most).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_tokens").collect())
        assert got == sorted((-1 if i is None else i, *count(t)) for i, t in rows)
    assert {(r.n_tokens > 1024) == r.over_limit for r in tokencount.op11_token_counts(d).collect()} == {True}
    assert tokencount.op11_token_counts(d.where("false")).count() == 0
    words = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))  # cut in another way: by the library alone
    few = d.where(F.length("text") < 100)
    assert {(r.text, r.n_tokens) for r in tokencount.count_tokens(few, path).join(few.select("doc_id", "text"), "doc_id").collect()} == {(t, len(words.encode(t, add_special_tokens=False).ids)) for i, t in rows if t is not None and len(t) < 100 and i}


def test_the_table_and_the_cache_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = tokencount.frequent_pieces(spark.createDataFrame([(f"a b c {i} of",) for i in range(300)], "text string").repartition(5), path, most=4)
    assert set(table.opened()) == {"a", " b", " c", " of"}
    held = type("Held", (), {"value": table})()
    look = tokencount._Lookup(path, held)
    assert look.counts(["q w e r t y u i o p a s d f", "a b " + "L" * 70, "z"]) == [len(look.cut.tokenizer.encode(t).ids) for t in ("q w e r t y u i o p a s d f", "a b " + "L" * 70, "z")]
    assert len(look.known) > 4 + 10 and "L" * 70 not in look.known
    look.counts(["a"])
    assert len(look.known) == 4


def plain_divergence(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs, counts, out = Counter(), {}, []
    for lang, source, text in rows:
        own = counts.setdefault(((lang or ""), (source or "")), Counter())
        own.update(words(text))
        docs.update({(lang or "", t) for t in words(text)})
    for lang in {k[0] for k in counts}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        groups = {s: {t: n[t] for t in kept} for (x, s), n in counts.items() if x == lang}
        share = lambda n: {t: 1 + 10**9 * (c + 5) // (sum(n.values()) + 5 * len(kept)) for t, c in n.items()}  # noqa: B023, E731
        p, q = {s: share(n) for s, n in groups.items()}, share({t: sum(n[t] for n in groups.values()) for t in kept})
        for s, own in p.items():
            pairs = sorted((-sum(abs(own[t] - other[t]) for t in kept), o.encode()) for o, other in p.items() if o != s)
            terms = sorted((q[t] - own[t], t.encode()) for t in kept if groups[s][t] and own[t] > q[t])[:top]
            out += [(lang, s, part, x.decode(), -v, k + 1) for part, items in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("block", "groups", "held"), [(256, 512, 1 << 18), (3, 2, 5), (1, 1, 40)])
def test_divergence(spark, block, groups, held):
    """Blocks of three terms, two sources to a side, and tasks that hold five counts give the same rows."""
    rng = random.Random(3)
    word = lambda: rng.choice(["The", "the", "Été", "été", "日本", "a1b", "x\x00y", "Z̈", *(f"w{chr(97 + k)}" for k in range(12))])
    rows = [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", "z", None]), " ".join(word() for _ in range(rng.randrange(30)))) for _ in range(150)]
    rows += [("en", "none", None), ("en", "none", "12 34"), ("xx", "s1", "lone"), ("xx", "s2", ""), ("yy", "s1", None), rows[0], rows[0], ("en", "s1", "the " * 30_000)]
    d = spark.createDataFrame(rows, "lang string, source string, text string").select("*", *[F.lit(3).alias(c) for c in OWN]).repartition(3)
    got = divergence.source_divergence(d, least=8, top=4, block=block, groups=groups, held=held)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows, 8, 4)


def test_long_texts_are_cut_at_blanks():
    text = "The été, x" + "\u65e5" * 50 + " a1b " * 40
    whole = [w for part in divergence._words(text.encode()) for w in part]
    assert whole[:3] == [b"the", "été".encode(), b"x" + "\u65e5".encode() * 50] and len(whole) == 83
    for most in (1, 7, 100):
        assert [w for part in divergence._words(text.encode(), most) for w in part] == whole
    assert list(divergence._words(b"")) == []


def test_divergence_of_nothing(spark):
    assert divergence.op12_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_shares_are_exact():
    for of in (7, 10**12, (1 << 63) // 1000 - 1, (1 << 63) // 1000 + 5):
        count = np.array([[1, of // 3, of - 1, of]], np.int64)
        assert divergence.shares(count, np.array([[of]], np.int64)).tolist() == [[1 + 10**9 * int(c) // of for c in count[0]]]


def plain_centroids(rows, k=16, dim=64):
    kept = [(i, [math.floor(64 * Fraction(v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in first[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for turn in range(4):
        own = [min((far(x, y), j) for j, y in enumerate(c)) for _, x in kept]
        if turn < 3:
            for j in range(len(c)):
                if mine := [x for (_, x), (_, at) in zip(kept, own, strict=True) if at == j]:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    whole = sum(d for d, _ in own)
    each = {j: sum(d for d, at in own if at == j) for j in range(len(c))}
    fits = lambda v: v if v < 1 << 63 else None
    return [(i, j, fits(d), fits(each[j]), fits(whole), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)]


@pytest.mark.parametrize("size", [0.3, 2.0**20, 2.0**29, 1e18, 1e307])
def test_centroids(spark, size):
    """float64 products, then int64, then Python's integers; distances beyond a long are null."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(64)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (None, [0.25] * 64), (7, [-0.0] * 64), rows[3], rows[3], (206, [0.1] * 64), (207, [0.1] * 64)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(3).alias(c) for c in OWN]).repartition(3)
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.op13_centroids(d).collect()]
    assert sorted(got, key=str) == sorted(plain_centroids(rows), key=str)


def test_few_vectors(spark):
    d = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.distance, r.inertia) for r in centroids.op13_centroids(d).collect()} == {(1, 0, 0), (2, 0, 0)}
    assert centroids.op13_centroids(d.where("false")).count() == 0


def test_float_products_only_where_they_are_exact():
    rng = np.random.default_rng(1)
    for top in (127, 2**24, 2**40):
        x, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (16, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
        assert centroids.squared_distances(x, c).tolist() == want
