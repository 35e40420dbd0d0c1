"""SentencePiece BPE with seeded merge-dropout, and its lossless inverse.

A text is cut into units that no merge can cross (blanks with the word after them, line ends). In a unit the agenda takes
the best mergeable pair of neighbours (highest piece score, leftmost first); a candidate is skipped for good if a keyed
hash of (seed, doc_id, the unit's place in the document, the candidate's place in the unit, the piece it would make) falls
under the dropout rate, so each occurrence is segmented on its own and depends on seed and document alone.
Units are encoded many at a time: every round merges the best pair of each unit that still has one. The first symbols of
a unit and the ranks of their pairs, which no skip changes, are kept; its merges are made anew for every occurrence.
Characters outside the vocabulary, and the blank mark itself, become byte pieces, so decoding gives the text back.

Defined results: null or empty text has no pieces and decodes to the empty text; with dropout 0 the pieces are those of
the library; repeated rows with the same doc_id get the same pieces; extra columns are kept by encode_documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import NONE, MergeTable, encode_units
from .common import fresh
from .ragged import Interned, Ragged

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
MOST_UNITS = 400_000
SPACE = "▁"
_UNIT = re.compile(rb"\n| +[^ \n]*|[^ \n]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary(MergeTable):
    """Pieces of a model and its table of merges, as arrays."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = np.zeros(256, np.int32)
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * n
        score = np.full(n, -np.inf)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.raw[i] = p.replace(SPACE, " ").encode()
                score[i] = sp.get_score(i)
        if any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("this model has pieces that cross units")
        self.start = np.full(0x110000, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.start[ord(" " if c == SPACE else c)] = i
        rank = np.empty(n, np.int32)
        rank[np.lexsort((np.arange(n), -score))] = np.arange(n)  # ties of scores: the smaller id
        made = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, whole = np.array(made, np.int64).reshape(-1, 3).T
        super().__init__(left, right, rank[whole], np.argsort(rank))

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all units, one after another, and the units' sizes; -2 - code point where there is no piece."""
        point = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self.start[point]
        lost = sym < 0
        sym[lost] = -2 - point[lost]
        return sym, np.fromiter(map(len, units), np.int64, len(units))

    def spelled(self, row: list[int]) -> list[int]:
        """A row of symbols with characters outside the vocabulary as byte pieces."""
        return [y for x in row for y in ([x] if x >= 0 else self.byte[list(chr(-2 - x).encode())].tolist())]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def occurrence_keys(doc: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The keys of the units at places of documents: 32 bits each."""
    own = _mix(doc + np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    return (_mix(own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def skipped(key: np.ndarray, place: np.ndarray, rank: np.ndarray, dropout: float) -> np.ndarray:
    """Whether each candidate is skipped: its hash under the occurrence's key falls under the rate."""
    h = place.astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    h += rank.astype(np.uint32) * np.uint32(0x85EBCA6B)
    h ^= key
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h < np.uint32(min(dropout, 1.0) * 0xFFFFFFFF)


class Skips:
    """Candidates skipped in units of the given keys, as encode_units asks for them."""

    def __init__(self, key: np.ndarray, dropout: float):
        self.key, self.dropout, self.least = key, dropout, int(np.uint32(min(dropout, 1.0) * 0xFFFFFFFF))

    def __call__(self, unit: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return skipped(self.key[unit], place, rank, self.dropout)

    def of(self, unit: int) -> UnitSkips:
        return UnitSkips(self.key[unit : unit + 1], self.dropout)


class UnitSkips(Skips):
    def __init__(self, key: np.ndarray, dropout: float):
        super().__init__(key, dropout)
        self.own = int(key[0])

    def __call__(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return skipped(self.key, place, rank, self.dropout)

    def one(self, place: int, rank: int) -> bool:
        """skipped() of one candidate, in Python's integers."""
        h = (place * 0x9E3779B1 + rank * 0x85EBCA6B & 0xFFFFFFFF) ^ self.own
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return (h ^ h >> 16) < self.least


class Encoder:
    """Encodes texts one after another and keeps the first symbols and pairs of the units it has met, within a bound."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.v, self.dropout, self.seed = vocabulary(path), dropout, seed
        self._reset()

    def _reset(self) -> None:
        self.units, self.known, self.symbols, self.pairs = Interned(), 0, Ragged(), Ragged()

    def _learn(self, new: np.ndarray) -> None:
        """First symbols of the units `new` (all that came last), or without dropout their ids."""
        flat, size = self.v.symbols([u.decode() for u in islice(self.units, self.known, None)])
        self.known = len(self.units)
        if not self.dropout:
            size, flat = encode_units(self.v, flat, size)
        self.symbols.put(new, size, flat)
        if self.dropout:
            pair = np.append(self.v.merges(flat[:-1], flat[1:]), NONE)
            pair[size.cumsum() - 1] = NONE
            self.pairs.missing(new)
            self.pairs.put(new, size, pair)

    def encode(self, raws: list[bytes], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text; keys: what names the document for the skips of its occurrences."""
        if len(self.units) > MOST_UNITS:
            self._reset()
        cuts = [_UNIT.findall(b" " + r) if r else [] for r in raws]
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        slots = np.fromiter(map(self.units.__getitem__, chain.from_iterable(cuts)), np.int64, int(n.sum()))
        new = self.symbols.missing(slots)
        if len(new):
            self._learn(new)
        size, flat = self.symbols.get(slots)
        if self.dropout:
            place = np.arange(len(slots)) - np.repeat(n.cumsum() - n, n)
            key = occurrence_keys(np.repeat(np.array(keys, np.uint64), n), place, self.seed)
            size, flat = encode_units(self.v, flat, size, Skips(key, self.dropout), self.pairs.get(slots)[1])
        ends = np.r_[0, size.cumsum()][n.cumsum()] if len(n) else np.zeros(0, np.int64)
        return np.split(flat, ends[:-1]) if len(ends) else []

    def decode(self, ids: np.ndarray) -> bytes:
        return decode(self.v, ids)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of the text whose pieces these are: the blank put before it goes."""
    return b"".join(map(v.raw.__getitem__, ids.tolist()))[1:]


def _parts(raws: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, r in enumerate(raws):
        total += len(r)
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(raws):
        yield lo, len(raws)


def _encoding(path: str, dropout: float, seed: int, text_at: int, key_at: int, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, dropout, seed)
        for b in batches:
            raws = b.column(text_at).cast(pa.binary()).fill_null(b"").to_pylist()
            keys = [k & 0xFFFFFFFFFFFFFFFF for k in b.column(key_at).to_pylist()]
            for lo, hi in _parts(raws):
                yield finish(enc, b.slice(lo, hi - lo), raws[lo:hi], enc.encode(raws[lo:hi], keys[lo:hi]))

    return run


def encode_documents(documents: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """documents with `pieces`, the ids of each whole text, as the last column; a column of that name is replaced."""
    documents = documents.drop("pieces")
    names, key = documents.columns, fresh(documents, "key")

    def finish(enc, b, raws, ids):
        off = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays([*b.columns[: len(names)], pieces], [*names, "pieces"])

    run = _encoding(path or public_tokenizers.path(MODEL), dropout, seed, names.index("text"), len(names), finish)
    schema = T.StructType([*documents.schema, T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return documents.withColumn(key, F.xxhash64("doc_id")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that `pieces` stand for."""
    at = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(at)
        for b in batches:
            texts = [decode(v, x.values.to_numpy()) if x.is_valid else b"" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))


def op6_pieces(documents: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_pieces, pieces_crc32 (ids as little-endian 32-bit), n_bytes and crc32 of the decoded text, lossless."""

    def finish(enc, b, raws, ids):
        back = [enc.decode(x) for x in ids]
        cols = [
            b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array([len(x) for x in back], pa.int64()), pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array([x == r for x, r in zip(back, raws, strict=True)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "pieces_crc32", "n_bytes", "text_crc32", "lossless"])

    run = _encoding(path or public_tokenizers.path(MODEL), dropout, seed, 1, 2, finish)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, pieces_crc32 long, n_bytes long, text_crc32 long, lossless boolean"
    return documents.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, schema)
