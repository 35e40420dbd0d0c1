"""Token-id output: documents tokenised whole, range-coded in blocks, and read back.

Documents are range-partitioned and sorted by doc_id, so partitions and the segments inside them are in ascending order.
A task tokenises its documents (each different word of about SLICE bytes of text once, each different piece once) and cuts the ids into segments of whole documents of about SEGMENT ids. A segment is coded by mixcoder in
independently reset, checksummed blocks; its row carries the ids and sizes of its documents. Rows are written with
Spark's Parquet writer, so any store it reaches will do, and each row can be read alone.

Defined results: null or empty text is the end id alone; null doc_ids come first; repeated rows each have their ids, in
order of their text's hash; a tokenizer file that describes other words than those cut here is used through the library alone; the text may hold the tokenizer's special strings, which give their ids as the library has it;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import mixcoder
from .bpe import MergeTable, encode_units
from .common import shared_dir, written
from .ragged import Interned, Ragged

MODEL = "word_bpe_49k.json"
END = 1
SEGMENT = 1 << 22
SLICE = 1 << 24  # bytes of text at a time
MOST_PIECES = 700_000
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already


# fixed values: how the file of the tokenizer that is cut here describes its normalizer and its pattern
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cut_here(path: str) -> bool:
    """True if the file describes the words that WordTokens cuts itself; texts for any other tokenizer go to the library whole."""
    file = json.loads(Path(path).read_text())
    pre = (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    held = (file["normalizer"] or {}).get("normalizers") == _NORMAL and pre[0].get("pattern") == {"Regex": _SPLIT} and [x.get("type") for x in pre[1:]] == ["ByteLevel"]
    return held and file["model"]["type"] == "BPE" and not file["model"]["dropout"] and all(x["content"].startswith("<|") for x in file["added_tokens"])


# fixed values: plain words are of ASCII and of the letters U+00C0 to U+017F, which NFC leaves alone and whose small letters have as many characters,
# and hold no special strings. Bytes and pairs of bytes of other words; the tokenizer's pattern for plain words in small letters and the blank between them
_OTHER = np.array([not (32 < c < 127 or 128 <= c <= 191 or 195 <= c <= 197) for c in range(256)])
_OTHER_PAIRS = tuple(b"\xc3\x97\xc3\xb7\xc4\xb0<|"[k : k + 2] for k in range(0, 8, 2))
_PIECE = re.compile(rb" |'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class WordMerges(MergeTable):
    """The merges of the tokenizer's file; a piece's last character is the symbol that ends words."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        ids, made = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in made], np.int64) for k in (0, 1))
        super().__init__(left, right, np.arange(len(made)), np.array([ids[a + b] for a, b in made]))
        same = [c for c in range(256) if 32 < c < 127 or 160 < c != 173]  # the byte map renames the others
        names = dict(zip(same, map(chr, same), strict=True)) | {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in same)}
        self.first, self.last = (np.array([ids.get(names[c] + end, -1) for c in range(256)], np.int32) for end in ("", model["end_of_word_suffix"]))

    def symbols(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, size = np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int64, len(units))
        sym = self.first[raw]
        end = size.cumsum() - 1
        sym[end] = self.last[raw[end]]
        return sym, size


def _plain(words: pa.Array) -> np.ndarray:
    """False for each word that only the library may cut; a plain one that ends before such a pair's second byte may go there too."""
    out = np.ones(len(words), bool)
    if len(words):
        off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
        raw = np.frombuffer(words.buffers()[2], np.uint8, int(off[-1] - off[0]), int(off[0])) if off[-1] > off[0] else np.zeros(0, np.uint8)
        bad = _OTHER[raw]
        for a, b in _OTHER_PAIRS:
            bad[:-1] |= (raw[:-1] == a) & (raw[1:] == b)
        out[off.searchsorted(np.flatnonzero(bad) + off[0], side="right") - 1] = False
    return out


class WordTokens:
    """Ids of texts, each different word of many texts cut once; keeps the pieces it has met, within a bound.

    Plain words between blanks are cut into the tokenizer's own pieces and merged here, many pieces at once; the others
    go to the library (the pre-tokenizer never joins what blanks part).
    """

    def __init__(self, path: str):
        self.tokenizer, self.merges = Tokenizer.from_file(path), WordMerges(path) if cut_here(path) else None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.known, self.rows = Interned(), 1, Ragged()
        self.rows.put(np.array([self.pieces[b" "]]), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return size, np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > MOST_PIECES:
            self._reset()
        text = b" ".join([*words, b""])
        cut = _PIECE.findall(text.lower() if text.isascii() else text.decode().lower().encode())
        slots = np.fromiter(map(self.pieces.__getitem__, cut), np.int64, len(cut))
        if len(self.pieces) > self.known:
            new = list(islice(self.pieces, self.known, None))
            self.rows.put(np.arange(self.known, len(self.pieces)), *encode_units(self.merges, *self.merges.symbols(new)))
            self.known = len(self.pieces)
        size, flat = self.rows.get(slots)
        ends = size.cumsum()[slots == 0]  # blanks end words
        return np.diff(ends, prepend=0), flat

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after another. No text is null."""
        if self.merges is None:
            return self._library(texts.cast(pa.binary()).to_pylist())
        cut = pc.ascii_split_whitespace(texts.cast(pa.string()))
        words = cut.flatten().dictionary_encode()
        kinds = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        plain = _plain(words.dictionary)
        rows = Ragged()
        for own, encode in ((plain, self._plain), (~plain, self._library)):
            if own.any():
                at = np.flatnonzero(own)
                rows.put(at, *encode(kinds[at].tolist()))
        if not len(kinds):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        size, ids = rows.get(words.indices.to_numpy())
        ends = np.r_[0, size.cumsum()][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return np.diff(ends), ids

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        size, ids = self.flat(pa.array(raws, pa.binary()))
        return np.split(ids, size.cumsum()[:-1]) if len(raws) else []


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One a worker, kept for its next tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about SLICE bytes at a time."""
    total = pc.binary_length(text).to_numpy().cumsum(dtype=np.int64)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE)))
        yield lo, hi
        lo = hi


def _coded(path: str, end: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_tokens(path), TaskContext.get().partitionId()
        names, sizes, ids, total, number, kind = [], [], [], 0, 0, None

        def row():
            flat = np.concatenate(ids)
            ids.clear()
            data = mixcoder.encode(flat, words.vocab)
            return _batch([[part], [number], [total], pa.concat_arrays(names), np.concatenate(sizes), [data]], kind)

        for b in batches:
            kind = b.schema.field(0).type
            text = b.column(1).fill_null("")
            for lo, hi in _slices(text):
                size, flat = words.flat(text.slice(lo, hi - lo))
                flat, size = np.insert(flat, size.cumsum(), end).astype(np.uint32), size + 1
                ends, at, done = size.cumsum(), 0, 0
                while at < len(size):  # a segment ends with the document that fills it
                    to = min(int(np.searchsorted(ends, done + segment - total)) + 1, len(size))
                    names.append(b.column(0).slice(lo + at, to - at))
                    sizes.append(size[at:to])
                    ids.append(flat[done : ends[to - 1]])
                    total += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if total >= segment:
                        yield row()
                        names, sizes, ids, total, number = [], [], [], 0, number + 1
        if ids:
            yield row()

    return run


def _batch(cols: list, kind: pa.DataType) -> pa.RecordBatch:
    """A row of part, segment, n_ids, doc_ids, sizes and data."""
    one = [pa.array(c, k) for c, k in zip(cols[:3], (pa.int32(), pa.int32(), pa.int64()), strict=True)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (cols[3], pa.array(cols[4], pa.int64()))]
    return pa.RecordBatch.from_arrays([*one, *lists, pa.array(cols[5], pa.binary())], ["part", "segment", "n_ids", "doc_ids", "sizes", "data"])


def write_ids(documents: DataFrame, path: str | None = None, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """Write the documents' ids in order of doc_id into the shared folder; the result reads those files."""
    spark = documents.sparkSession
    shared_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # a hot id is parted
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()),
    ])
    return written(docs.mapInArrow(_coded(path or public_tokenizers.path(MODEL), end, segment), schema), "token-ids")


def read_ids(files: DataFrame, ids: bool = True) -> DataFrame:
    """part, segment, at (ids before it in its segment), doc_id, n_tokens, ids_crc32 and, if asked for, ids of every document."""
    kind = files.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flat = mixcoder.decode(b.column(4)[k].as_py()).astype("<u4")
                size = b.column(3)[k].values.to_numpy()
                start = size.cumsum() - size
                crc = [zlib.crc32(flat[s : s + n]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                m = len(size)
                cols = [pa.array(np.full(m, b.column(0)[k].as_py(), np.int32)), pa.array(np.full(m, b.column(1)[k].as_py(), np.int32)), pa.array(start, pa.int64()), b.column(2)[k].values, pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[start, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return files.select("part", "segment", "doc_ids", "sizes", "data").mapInArrow(run, T.StructType(fields))


def op10_token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    files = write_ids(documents, path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "segment", "n_ids").join(parts, "part")
    segments = segments.select("part", "segment", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    out = read_ids(files, ids=False).join(segments, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
