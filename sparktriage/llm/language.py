"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

Training counts hashed byte n-grams of folded text by language, on the executors, over a bounded labelled sample; the table
of at most BUCKETS x languages counts gives smoothed n-gram likelihoods. A document is the multiset of its n-grams; EM fits
the proportions of all languages, and the set kept is the smallest one of the most probable languages that the
likelihood less a penalty of half a log of the n-grams for each language prefers. The largest share is the prediction.

Defined results: null text, or text without a letter, is `und` with score 0; a text is read whole whatever its length;
without training rows every text is `und`; ties go to the language first in order of name; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample

MAX_TRAIN = 20_000
BITS = 14
BUCKETS = 1 << BITS
ROUNDS, STEADY = 60, 1e-3  # EM ends once no share moves by STEADY
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts by bucket of the byte 3-grams of the folded text, words set apart by blanks; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    code = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(code >> np.uint32(32 - BITS), minlength=BUCKETS)


@dataclass
class LanguageModel:
    names: list[str]
    p: np.ndarray  # BUCKETS x languages

    def infer(self, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Languages of the selected set, most probable first, and their proportions."""
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(np.float64), self.p[at]
        n, k = c.sum(), len(self.names)
        share = self._fit(c, p, np.full(k, 1.0 / k), n)
        order = np.lexsort((np.arange(k), -share))
        penalty = 0.5 * np.log(max(n, 2.0)) + 3.0
        best, kept, own = -np.inf, [], np.ones(1)
        for size in range(1, k + 1):
            among = order[:size]
            if size > 1 and share[among[-1]] < 1e-3:
                break
            part = share[among] / share[among].sum()
            part = self._fit(c, p[:, among], part, n) if size > 1 else part
            value = float(c @ np.log(p[:, among] @ part)) - penalty * size
            if value <= best:
                break
            best, kept, own = value, among.tolist(), part
        rank = np.lexsort((kept, -own))
        return [kept[i] for i in rank], own[rank]

    @staticmethod
    def _fit(c: np.ndarray, p: np.ndarray, share: np.ndarray, n: float) -> np.ndarray:
        for _ in range(ROUNDS):
            each = p * share
            new = (c / each.sum(1)) @ each / n
            if np.abs(new - share).max() < STEADY:
                return new
            share = new
        return share


def train_language(documents: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Fit on at most max_train documents with a language, outside the held-out fold (crc32 mod 4 = 2)."""
    rows = documents.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(crc_mod(F.col("doc_id"), 4) != 2)
    rows = labelled_sample(rows, max_train, "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (c := gram_counts(text)) is not None:
                    total[lang] = total.get(lang, 0) + c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    p = np.full((BUCKETS, len(names)), 0.5)
    p[got["bucket"].to_numpy(int), [names.index(x) for x in got["lang"]]] += got["n"].to_numpy(float)
    return LanguageModel(names, p / p.sum(0)) if names else LanguageModel([], p)


def predict_language(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, languages (the selected set with proportions, as text) of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages doubles at most
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                counts = gram_counts(text) if m.names else None
                if counts is None:
                    rows.append(("und", 0.0, ""))
                    continue
                kept, share = m.infer(counts)
                rows.append((m.names[kept[0]], min(1.0, float(share[0])), ",".join(f"{m.names[i]}:{s:.3f}" for i, s in zip(kept, share, strict=True))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True)]], ["doc_id", "lang_pred", "score", "languages"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages string")


def op5_language(documents: DataFrame) -> DataFrame:
    out = predict_language(documents, train_language(documents))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages")
