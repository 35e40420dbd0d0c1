"""Trained models' inference against plain loops, and many records of mixed layouts."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparktriage.llm import chat, language, toxicity


def small_cnn(rng):
    m = toxicity.TextCNN(
        np.where(rng.random(1 << toxicity.BITS) < 0.7, rng.integers(1, 60, 1 << toxicity.BITS), 0).astype(np.int32), rng.normal(0, 1, (60, toxicity.DIM)).astype(np.float32),
        {w: rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, {w: rng.normal(0, 0.2, toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS},
        rng.normal(0, 0.4, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.1, ["de", "en"], np.log(rng.dirichlet([1] * 60, 2).T).astype(np.float32), [0.4, 0.6], 0.5,
    )
    m.emb[toxicity.PAD] = 0
    m.fold()
    return m


def plain_score(m, words):
    """One text: filters at every place, padded behind, the greatest value of each, a logistic unit, the language's threshold at 0.7."""
    seq = [*words, *[toxicity.PAD] * max(toxicity.WIDTHS)]
    feats = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            values = [sum(float(m.emb[seq[i + j]] @ m.filters[w][j, :, f]) for j in range(w)) for i in range(len(seq) - w + 1)]
            feats.append(max(0.0, max(values) + float(m.shift[w][f])))
    p = 1 / (1 + math.exp(-(sum(x * float(o) for x, o in zip(feats, m.out, strict=True)) + m.bias)))
    lang = max(range(2), key=lambda i: (sum(float(m.lang_log[x, i]) for x in words), -i))
    cut = m.cuts[lang]
    return 0.7 * p / cut if p < cut else 0.7 + 0.3 * (p - cut) / (1 - cut)


def test_toxicity_scores_equal_the_plain_network():
    rng = np.random.default_rng(2)
    m = small_cnn(rng)
    texts = ["", None, "one", "a b", "x y z", *[" ".join(f"w{rng.integers(300)}" for _ in range(n)) for n in (1, 4, 9, 40, 200)]]
    docs = [m.index[toxicity.word_rows(t)] for t in texts]
    want = [plain_score(m, d.tolist()) for d in docs]
    assert np.allclose(m.score(docs), want, atol=1e-4)
    assert np.allclose([m.score([d])[0] for d in docs], want, atol=1e-4)  # alone as among others


def plain_mixture(counts, p, names):
    """Expectation-maximisation over all grams, set by set of the leading languages, as long as the penalised likelihood grows."""
    grams = [(b, int(c)) for b, c in enumerate(counts) if c]
    n = sum(c for _, c in grams)

    def fit(among, share):
        for _ in range(language.ROUNDS):
            new = [0.0] * len(among)
            for b, c in grams:
                each = [s * p[b, k] for s, k in zip(share, among, strict=True)]
                new = [x + c * e / sum(each) for x, e in zip(new, each, strict=True)]
            new = [x / n for x in new]
            if max(abs(a - b) for a, b in zip(new, share, strict=True)) < language.STEADY:
                return new
            share = new
        return share

    every = list(range(len(names)))
    share = fit(every, [1 / len(names)] * len(names))
    order, best, kept = sorted(every, key=lambda k: (-share[k], k)), -math.inf, None
    for size in range(1, len(names) + 1):
        among = order[:size]
        if size > 1 and share[among[-1]] < 1e-3:
            break
        part = [share[k] / sum(share[j] for j in among) for k in among]
        part = fit(among, part) if size > 1 else part
        value = sum(c * math.log(sum(p[b, k] * s for s, k in zip(part, among, strict=True))) for b, c in grams) - size * (0.5 * math.log(max(n, 2)) + 3)
        if value <= best:
            break
        best, kept = value, sorted(zip([-s for s in part], among, strict=True))
    return [k for _, k in kept], [-s for s, _ in kept]


def test_language_mixtures_equal_the_plain_one():
    rng, words = random.Random(5), {"aa": "bada kodo lumi neva", "bb": "zrak shum tlen vrih", "cc": "ouie aeou uioa eiao", "dd": "bada zrak kodo shum"}
    text = lambda k, n: " ".join(rng.choice(words[k].split()) + rng.choice(["", "x", "en"]) for _ in range(n))
    p = np.full((language.BUCKETS, len(words)), 0.5)
    for k, name in enumerate(words):
        p[:, k] += language.gram_counts(text(name, 4000))
    m = language.LanguageModel(list(words), p / p.sum(0))
    texts = [text("aa", 200), f"{text('aa', 300)} {text('bb', 200)}", f"{text('bb', 80)} {text('cc', 80)} {text('aa', 80)}", text("dd", 60), "a", "badazrak", text("cc", 5) + text("dd", 5)]
    sizes = set()
    for t in texts:
        c = language.gram_counts(t)
        kept, share = m.infer(c)
        want, parts = plain_mixture(c, m.p, m.names)
        assert kept == want and np.allclose(share, parts, atol=1e-9), t[:30]
        sizes.add(len(kept))
    assert {1, 2} <= sizes
    twice = language.LanguageModel(["aa", "ab"], m.p[:, [0, 0]])
    assert twice.infer(language.gram_counts(texts[0]))[0] == [0]  # a tie: the first name


def test_many_records_of_mixed_layouts(spark):
    """10,000 JSON records of every layout, broken, deep and foreign ones among them, to turns and through the template and back."""
    rng = random.Random(6)
    make = [
        lambda u, a: ({"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a, "extra": 1}]}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"dialog": [{"speaker": "user", "text": u}]}, [("user", u)]),
        lambda u, a: ({"instruction": u, "input": "", "output": a, "id": 4}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"prompt": u, "completion": a, "system": "be brief"}, [("system", "be brief"), ("user", u), ("assistant", a)]),
        lambda u, a: ({"prompt": u, "response": a}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"question": u, "answer": a}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"data": {"messages": [{"role": "user", "content": u}, {"role": "bot", "content": a}]}}, [("user", u), ("assistant", a)]),
        lambda u, a: ({"other": u}, []),
    ]
    rows, want = [], {}
    for k in range(10_000):
        u, a = f"q{k} <|turn|> \\l", rng.choice(["</s>[INST]", "ok\nok", "é", ""])
        record, turns = rng.choice(make)(u, a)
        text = json.dumps(record, ensure_ascii=rng.random() < 0.5)
        if k % 500 == 7:
            text, turns = rng.choice(["[" * 50_000, '{"prompt": "\\ud800", "response": "x"}', "{", None, "", "7"]), []
        rows.append((k, text))
        want[k] = turns
    made = chat.json_turns(spark.createDataFrame(rows, "conv_id long, record string").repartition(4), "conv_id", "record")
    out = chat.format_turns(made).select("conv_id", "formatted", F.size("loss").alias("n")).collect()
    assert len(out) == 10_000
    for r in out:
        assert chat.read_turns(r.formatted) == want[r.conv_id]
        assert r.n == sum(role == "assistant" for role, _ in want[r.conv_id])
