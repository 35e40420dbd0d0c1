"""Token counts by a map-side look-up of two tiers; no pre-token is ever shuffled.

Pass one: each task counts the pre-tokens of its texts in a table of bounded size; the tasks' summaries, each of a fixed size,
are merged in a tree. The most frequent pre-tokens become a compact table (one string, one array of lengths) that is
broadcast. Pass two: each text is cut again and its pieces looked up, first in that table, then in the worker's own cache of
what the tokenizer has told; only pieces in neither are encoded. The table decides the cost alone, never a count.

Texts are cut here as the tokenizer's own byte-level pattern cuts them. Texts with one of its special strings, or with a
character that it takes for another kind than this pattern does (each character is asked for once), and all texts of any
other tokenizer file, are encoded whole by the library.

Defined results: null or empty text has no bytes and no tokens; repeated rows and ids have a row each, null ids too; extra columns
are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
FREQUENT = 1 << 16  # pre-tokens in the broadcast table
CACHED = 1 << 19  # pre-tokens a worker keeps besides
LONGEST = 64  # characters of a pre-token that is kept
AT_ONCE = 1 << 19  # characters cut at once
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already

# fixed values: the byte-level tokenizer's pattern, for all characters and for ASCII
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Cutter:
    """Texts to the tokenizer's pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(Path(path).read_text())
        pre = file["pre_tokenizer"] or {}
        self.whole = file["normalizer"] is not None or any(pre.get(k) != v for k, v in _PLAIN.items())
        self.special = [x["content"] for x in file["added_tokens"]]
        self.even: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def _ask(self, c: str) -> None:
        probe = f"a{c}a 0{c}0 !{c}! {c}{c}"
        own = [probe[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        (self.even if own == _ANY.findall(probe) else self.odd).add(c)

    def usual(self, text: str) -> bool:
        """True if the pattern cuts the text as the library does."""
        if self.whole or any(x in text for x in self.special):
            return False
        if text.isascii():
            return True
        for c in (held := set(text)) - self.even - self.odd:
            self._ask(c)
        return held.isdisjoint(self.odd)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a usual text; a long text comes in lists of a bounded length."""
        pattern = _ASCII if text.isascii() else _ANY
        if len(text) <= AT_ONCE:
            yield pattern.findall(text)
            return
        all_ = (m[0] for m in pattern.finditer(text))
        while part := list(islice(all_, AT_ONCE // 4)):
            yield part

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


_CUTTERS: dict[str, Cutter] = {}
_TABLES: dict[tuple[str, str], dict[str, int]] = {}


def cutter(path: str) -> Cutter:
    """One a worker, kept for its next tasks."""
    if path not in _CUTTERS:
        _CUTTERS[path] = Cutter(path)
    return _CUTTERS[path]


class Frequent:
    """Pre-tokens and their numbers of tokens, as one string and one array. A worker opens it into a table to look up in."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.text, self.mark = "".join(pieces), uuid.uuid4().hex
        self.size = np.array([len(x) for x in pieces], np.uint8)
        self.counts = np.array(counts, np.uint8)  # a piece has at most 4 * LONGEST bytes, so no more tokens

    def opened(self) -> dict[str, int]:
        end = self.size.cumsum(dtype=np.int64)
        return {self.text[e - n : e]: c for e, n, c in zip(end.tolist(), self.size.tolist(), self.counts.tolist(), strict=True)}


def _texts(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[str]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            yield from b.column(column).slice(lo, 256).to_pylist()


def _trimmed(n: Counter, most: int) -> Counter:
    return Counter(dict(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]))


def _packed(n: Counter) -> bytes:
    return json.dumps(list(n.items()), ensure_ascii=False, separators=(",", ":")).encode()


def _merged(a: bytes, b: bytes, most: int) -> bytes:
    n = Counter(dict(json.loads(a)))
    n.update(dict(json.loads(b)))
    return _packed(_trimmed(n, most))


def frequent_pieces(documents: DataFrame, path: str, most: int = FREQUENT) -> Frequent:
    """The most frequent pre-tokens over all texts, about: a task keeps the counts of at most 8 * most pieces, hands 2 * most on."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, n = cutter(path), Counter()
        for text in _texts(batches):
            if text and cut.usual(text):
                for part in cut.pieces(text):
                    n.update(part)
                    if len(n) > 8 * most:
                        n = _trimmed(n, 4 * most)
        n = Counter({k: v for k, v in n.items() if len(k) <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array([_packed(_trimmed(n, 2 * most))], pa.binary())], ["n"])

    told = documents.select("text").mapInArrow(summary, "n binary").rdd.map(lambda r: bytes(r.n))
    depth = max(2, math.ceil(math.log(max(2, told.getNumPartitions()), 8)))  # so that the driver merges eight summaries at most
    n = Counter(dict(json.loads(told.treeReduce(lambda a, b: _merged(a, b, 2 * most), depth) if told.getNumPartitions() else b"[]")))
    pieces = [k for k, v in _trimmed(n, most).items() if v > 1]
    return Frequent(pieces, cutter(path).counts(pieces))


class _Lookup:
    """Numbers of tokens of texts: the broadcast table, then the worker's cache, then the library."""

    def __init__(self, path: str, held):
        self.cut, self.held = cutter(path), held
        key = (path, held.value.mark)
        if key not in _TABLES:
            _TABLES.clear()  # of an earlier query
            _TABLES[key] = held.value.opened()
        self.known, self.frequent = _TABLES[key], len(held.value.size)

    def _learn(self, parts: list[list[str]]) -> None:
        if len(self.known) > self.frequent + CACHED:
            self.known.clear()
            self.known.update(self.held.value.opened())
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        for lo in range(0, len(new), 4096):
            self.known.update(zip(new[lo : lo + 4096], self.cut.counts(new[lo : lo + 4096]), strict=True))
        self.long = [x for x in new if len(x) > LONGEST]

    def _forget(self) -> None:
        for x in self.long:
            self.known.pop(x, None)

    def counts(self, texts: list[str]) -> list[int]:
        """Of texts of about AT_ONCE characters together; a longer text comes alone."""
        out, at, parts = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not self.cut.usual(text):
                out[i] = self.cut.count(text)
            elif len(text) > AT_ONCE:
                for part in self.cut.pieces(text):
                    self._learn([part])
                    out[i] += sum(map(self.known.__getitem__, part))
                    self._forget()
            else:
                at.append(i)
                parts += self.cut.pieces(text)
        self._learn(parts)
        for i, part in zip(at, parts, strict=True):
            out[i] = sum(map(self.known.__getitem__, part))
        self._forget()
        return out


def count_tokens(documents: DataFrame, path: str | None = None, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text. `most` bounds the broadcast table, of LONGEST characters a piece at most."""
    path = path or public_tokenizers.path(MODEL)
    held = documents.sparkSession.sparkContext.broadcast(frequent_pieces(documents, path, most))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None
        for b in batches:
            look = look or _Lookup(path, held)
            raw = pc.fill_null(b.column(1), "")
            out, own, size = [], [], 0
            for text in _texts([b], 1):
                own.append(text or "")
                size += len(own[-1])
                if size >= AT_ONCE:
                    out, own, size = out + look.counts(own), [], 0
            out += look.counts(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(raw).cast(pa.int64()), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op11_token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    return count_tokens(documents, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
