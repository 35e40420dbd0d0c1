"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by inferred language.

Words hash to buckets; a bucket that enough training texts hold has a row of an embedding table, all others share row 0,
which stays zero, so a rare word is no evidence. Filters of several widths slide over the whole text, each gives its maximum
(through a rectifier), a logistic layer reads the maxima. Scoring folds embeddings and filters into one table for each offset
of a filter, so a position costs a gather and a sum. A naive Bayes over the same hashed words infers the language of a
text, from text alone; on a part of the training rows each language gets the threshold of best F1, and scores are stretched
monotonically so that this threshold lies at 0.7. Languages with too few positive rows take the common threshold.

Defined results: null or empty text scores as a text without words; texts are read whole; repeated label rows count once
each; labels that are null or of unknown documents are ignored; with one class only, the score is its smoothed share,
kept on that class's side of 0.7; without any usable label too, every score is on the side of 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, bounded_labels, crc_mod, drop_table, written

MAX_TRAIN, MAX_WORDS = 16_000, 10_000_000
ROW_WORDS = 64  # a row of the fit counts as so many words at least
THRESHOLD = 0.7
BITS, DIM, FILTERS, WIDTHS = 20, 8, 8, (1, 2, 3)
PAD = 0
EPOCHS, BATCH = 10, 48
DROPOUT, DECAY, SHARE = 0.3, 2e-3, 0.002
FEW = 15
_WORD = re.compile(r"[^\W_]+")


class _Rows(dict):
    """word -> bucket."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode()) >> (32 - BITS)
        return n


_ROWS = _Rows()


def word_rows(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_ROWS.__getitem__, words), np.int32, len(words))


@dataclass
class TextCNN:
    index: np.ndarray  # bucket -> row
    emb: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    shift: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    lang_log: np.ndarray | None = None  # rows x languages
    cuts: list[float] = field(default_factory=list)
    cut: float = THRESHOLD
    tables: dict | None = None

    def fold(self) -> None:
        self.tables = {w: [(self.emb @ f[j]).astype(np.float32) for j in range(w)] for w, f in self.filters.items()}

    def maxima(self, docs: list[np.ndarray]):
        """Pooled features of the texts, and for each the position of its maximum in the joined sequence."""
        gap = np.full(max(WIDTHS), PAD, np.int32)
        flat = np.concatenate([x for d in docs for x in (d, gap)])
        size = np.array([len(d) + len(gap) for d in docs])
        start = size.cumsum() - size
        feats, places = [], []
        for w in WIDTHS:
            t = self.tables[w]
            n = len(flat) - w + 1
            a = t[0][flat[:n]]
            for j in range(1, w):
                a = a + t[j][flat[j : j + n]]
            for j in range(1, w):  # windows that begin in a text's padding and reach into the next text are none of its own
                last = start + size - j
                a[last[last < n]] = -np.inf
            top = np.maximum.reduceat(a, start, axis=0)
            feats.append(np.maximum(top + self.shift[w], 0))
            places.append((a, top))
        return np.concatenate(feats, 1), places, flat, start, size

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.maxima(docs)[0] @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def language(self, doc: np.ndarray) -> int:
        return int(self.lang_log[doc].sum(0).argmax()) if len(self.languages) else -1

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        p = self.raw(docs)
        cut = np.array([self.cuts[i] if (i := self.language(d)) >= 0 else self.cut for d in docs])
        return np.where(p < cut, THRESHOLD * p / cut, THRESHOLD + (1 - THRESHOLD) * (p - cut) / np.maximum(1 - cut, 1e-9)).clip(0, 1)


def _adam(p, g, state, rate, step):
    m, v = state
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, in the middle of the gap below it."""
    order = np.argsort(-p, kind="stable")
    hit = y[order].cumsum()
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    s = p[order]
    f1[:-1][s[1:] == s[:-1]] = -1
    i = int(f1.argmax())
    return float(np.clip((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2, 0.02, 0.98))


def _in_parts(m: TextCNN, docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    return np.concatenate([m.raw([docs[i] for i in part]) for part in np.array_split(rows, max(1, len(rows) // 64)) if len(part)])


def fit_cnn(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 11) -> TextCNN:
    rng = np.random.default_rng(seed)
    n, pos = len(y), float(y.sum())
    held = np.zeros(1 << BITS, np.int32)  # texts that hold a bucket
    for d in docs:
        held[np.unique(d)] += 1
    kept = np.flatnonzero(held >= max(4, SHARE * n))
    index = np.zeros(1 << BITS, np.int32)
    index[kept] = np.arange(1, len(kept) + 1)
    docs = [index[d] for d in docs]
    emb = rng.normal(0, 0.3, (len(kept) + 1, DIM)).astype(np.float32)
    emb[PAD] = 0
    filters = {w: rng.normal(0, (1.0 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    shift = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    prior = (pos + 1) / (n + 2)
    m = TextCNN(index, emb, filters, shift, out, float(np.log(prior / (1 - prior))))
    if n < 40 or pos == 0 or pos == n:
        m.out[:] = 0
        m.cut = min(max(prior + (0.01 if pos == 0 else -0.01), 0.01), 0.99) if pos in (0, n) else THRESHOLD
        m.fold()
        return m
    fold = rng.permutation(n) % 4 == 0  # the part that calibrates
    train, cal = np.flatnonzero(~fold), np.flatnonzero(fold)
    least, best = np.inf, None
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in [("emb", emb), ("out", out), *[(f"f{w}", filters[w]) for w in WIDTHS], *[(f"s{w}", shift[w]) for w in WIDTHS]]}
    step = 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            m.fold()
            part = [docs[i] for i in rows]
            feats, places, flat, start, size = m.maxima(part)
            on = (rng.random(feats.shape) >= DROPOUT) / np.float32(1 - DROPOUT)
            feats = (feats * on).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(feats @ m.out + m.bias, -30, 30)))
            d = ((p - y[rows]) / len(rows)).astype(np.float32)
            rate = 0.01 * 0.85**epoch
            grads = {"out": feats.T @ d + 1e-4 * m.out, "emb": DECAY * emb / len(emb)}
            back = (d[:, None] * m.out[None, :]) * on * (feats > 0)
            for k, w in enumerate(WIDTHS):
                a, top = places[k]
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"s{w}"], gf = g.sum(0), np.zeros_like(filters[w])
                own = np.repeat(np.arange(len(part)), size)[: len(a)]
                at, c = np.nonzero(a == top[own])
                i = own[at]
                _, first = np.unique(i * FILTERS + c, return_index=True)  # the first place of each maximum
                at, c, i = at[first], c[first], i[first]
                live = np.flatnonzero(g[i, c])
                at, c, by = at[live], c[live], g[i[live], c[live]][:, None]
                for j in range(w):
                    row = flat[at + j]
                    np.add.at(gf[j].T, c, by * emb[row])
                    np.add.at(grads["emb"], row, by * filters[w][j, :, c])
                grads[f"f{w}"] = gf
            grads["emb"][PAD] = 0
            for k, v in [("emb", emb), ("out", m.out), *[(f"f{w}", filters[w]) for w in WIDTHS], *[(f"s{w}", shift[w]) for w in WIDTHS]]:
                _adam(v, grads[k], state[k], rate, step)
            m.bias -= rate * float(d.sum())
        m.fold()
        p = _in_parts(m, docs, cal)
        loss = -float(np.mean(np.where(y[cal] > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        if loss < least:
            least, best = loss, (emb.copy(), {w: f.copy() for w, f in filters.items()}, {w: f.copy() for w, f in shift.items()}, m.out.copy(), m.bias)
    m.emb, m.filters, m.shift, m.out, m.bias = best
    m.fold()
    m.languages = sorted({x for x in langs if x is not None})
    if m.languages:
        count = np.full((len(emb), len(m.languages)), 0.2)
        for doc, lang in zip(docs, langs, strict=True):
            if lang is not None:
                np.add.at(count[:, m.languages.index(lang)], doc, 1.0)
        m.lang_log = np.log(count / count.sum(0)).astype(np.float32)
    p = _in_parts(m, docs, cal)
    own = np.array([m.language(docs[i]) for i in cal])
    m.cut = _best_cut(p, y[cal]) if y[cal].any() else THRESHOLD
    m.cuts = [_best_cut(p[own == i], y[cal][own == i]) if y[cal][own == i].sum() >= FEW else m.cut for i in range(len(m.languages))]
    return m


def within_words(held: DataFrame, max_words: int) -> DataFrame:
    """Rows (doc_id, rows, n) of at most max_words words together, a row counting as ROW_WORDS at least: those whose hash is under a threshold.

    Only if all are too many: texts of over 1/64 of max_words are left out, so that no single text takes the place of many.
    """
    cost, below = F.greatest("n", F.lit(ROW_WORDS)), KEYS
    total = lambda df: df.agg(F.sum(cost)).first()[0] or 0
    if (n := total(held)) <= max_words:
        return held
    held = held.where(cost <= max_words // 64)
    key = F.pmod(F.xxhash64("doc_id", "rows"), F.lit(KEYS))
    n = total(held)
    while n > max_words:
        below = below * max_words * 15 // (n * 16)
        n = total(held.where(key < F.lit(below)))
    return held.where(key < F.lit(below))


def train_toxicity(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> TextCNN:
    """Fit on at most max_train labelled documents of at most max_words words together, outside the held-out fold (crc32 mod 3 = 1).

    Both bound what reaches the driver; texts are never cut, fewer are taken. Words are hashed on the executors.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("double").alias("__y")).where("doc_id is not null and __y in (0, 1)")
    rows = bounded_labels(rows.where(crc_mod(F.col("doc_id"), 3) != 1), max_train, "toxicity")
    chosen = documents.select("doc_id", "lang", "text").join(F.broadcast(rows), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [word_rows(x).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary()), pa.array([len(x) // 4 for x in raw], pa.int64())], ["doc_id", "__y", "lang", "rows", "n"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = written(chosen.select("doc_id", "__y", "lang", "text").mapInArrow(hashed, f"doc_id {kind}, __y double, lang string, rows binary, n long"), "hashed")
    got = within_words(held, max_words).toPandas().sort_values(["doc_id", "__y", "lang"], kind="stable")
    drop_table(held)
    docs = [np.frombuffer(x, np.int32) for x in got["rows"]]
    return fit_cnn(docs, got["__y"].to_numpy(np.float32), [x if isinstance(x, str) else None for x in got["lang"]])


def score_toxicity(documents: DataFrame, model: TextCNN) -> DataFrame:
    """doc_id, score of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            docs = [m.index[word_rows(x)] for x in b.column(1).to_pylist()]
            score, lo, total = [], 0, 0
            for i, d in enumerate(docs):
                total += len(d) + len(WIDTHS)
                if total > 50_000 or i + 1 == len(docs):
                    score.append(m.score(docs[lo : i + 1]))
                    lo, total = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(documents, train_toxicity(documents, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
