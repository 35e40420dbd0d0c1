"""Divergence of the sources of a language, term by term, in exact integers.

Tasks count the terms of their texts by (lang, source) in tables of bounded size; Spark adds the counts up. The kept terms of a
language are dealt into blocks of about BLOCK terms. A block and its sources make a dense int64 tile, source by term; the
probabilities of all pairs of its sources are compared by broadcasting, a few terms at a time. A task adds the pair matrices of its
blocks up and keeps a heap of the best terms of each source, then hands on one row a pair and at most `top` terms a source; Spark adds
and ranks these. With more than GROUPS sources in a language they are dealt into groups, and a tile is made for each pair of groups.

Defined results: null text, lang and source count as ''; a source whose texts have no term, or none that is kept, still has its
pairs; a language without kept terms has divergence 0; repeated rows count as often as they stand there; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if, written

LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
BLOCK = 256  # terms of a tile, about
GROUPS = 512  # sources of a tile and side
CELLS = 1 << 22  # values compared at once
HELD = 1 << 18  # counts that a task holds
PIECE = 1 << 22  # bytes of a text whose terms are listed at once
_PARTS = bytes(c if chr(c) in LOWER or c > 127 else ord(LOWER[c - 65]) if chr(c) in UPPER else 32 for c in range(256))  # letters and blanks


def _words(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in lists of a bounded length; a long text is cut at blanks."""
    text, lo = text.translate(_PARTS), 0
    while lo < len(text):
        hi = text.find(b" ", lo + most)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def term_counts(documents: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents with the term, several rows for the same key; term '' once a task and source."""

    def flushed(n: dict, docs: dict) -> pa.RecordBatch:
        rows = [(*key, t, c, docs[key][t]) for key, own in n.items() for t, c in own.items()] + [(*key, b"", 0, 0) for key in n]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*out[:2], out[2].cast(pa.string()), *out[3:]], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, size = {}, {}, 0
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key not in n:
                    n[key], docs[key], size = Counter(), Counter(), size + 1
                own = n[key]
                size -= len(own)
                seen: set[bytes] = set()
                for words in _words(b.column(2)[i].as_buffer().to_pybytes()):
                    own.update(words)
                    seen.update(words)
                docs[key].update(seen)
                size += len(own)
                if size > held:
                    yield flushed(n, docs)
                    n, docs, size = {}, {}, 0
        yield flushed(n, docs)

    got = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return got.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(documents: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """lang, source, term, n, total (of the language), lead (true in one row a term), for terms in at least so many documents of their
    language; term '' for every source. One shuffle, of what tasks have added up."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = term_counts(documents, held).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    n = n.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.col("source") == F.min("source").over(term)).alias("lead"))
    return written(n.where((F.col("docs") >= least) | (F.col("term") == "")).drop("docs"), "term-counts")


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / of) without overflow: three digits at a time, exact while `of` is under 2^63 / 1000."""
    if int(of.max(initial=0)) >= (1 << 63) // 1000:
        return (1 + UNIT * count.astype(object) // of.astype(object)).astype(np.int64)
    out, rest = count // of, count % of
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def pair_sums(p: np.ndarray, q: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For all pairs of rows of two tiles: the sum of absolute differences over the tiles' terms."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, cells // max(1, out.size))
    for lo in range(0, p.shape[1], step):
        out += np.abs(p[:, None, lo : lo + step] - q[None, :, lo : lo + step]).sum(2)
    return out


def best_terms(f: np.ndarray, terms: np.ndarray, top: int) -> list[tuple[int, str]]:
    """The `top` greatest positive values with their terms, ties to the smaller term; as (-value, term), in order."""
    at = np.flatnonzero(f > 0)
    if len(at) > top:
        least = np.partition(f[at], len(at) - top)[len(at) - top]
        at = at[f[at] >= least]
    return heapq.nsmallest(top, zip((-f[at]).tolist(), terms[at].tolist(), strict=True), key=lambda x: (x[0], x[1].encode()))


_CELL = ["lang", "one", "two", "block"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each tile, from rows sorted by tile."""
    rest = []
    for b in batches:
        f = b.to_pandas()
        if not len(f):
            continue
        cut = np.flatnonzero((f[_CELL].to_numpy()[1:] != f[_CELL].to_numpy()[:-1]).any(1)) + 1
        parts = [f.iloc[i:j] for i, j in zip([0, *cut], [*cut, len(f)], strict=True)]
        if rest and tuple(rest[0][_CELL].iloc[0]) != tuple(parts[0][_CELL].iloc[0]):
            yield tuple(rest[0][_CELL].iloc[0]), pd.concat(rest)
            rest = []
        if len(parts) > 1:
            yield tuple(parts[0][_CELL].iloc[0]), pd.concat([*rest, parts[0]])
            for p in parts[1:-1]:
                yield tuple(p[_CELL].iloc[0]), p
            rest = []
        rest.append(parts[-1])
    if rest:
        yield tuple(rest[0][_CELL].iloc[0]), pd.concat(rest)


def _compared(top: int, smooth: int):
    def rows(part: str, lang: str, source: str, items) -> list[tuple]:
        return [(part, lang, source, item, value) for item, value in items]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.int64())], ["part", "lang", "source", "item", "value"])

    def told(key, names, sums, heaps) -> Iterator[pa.RecordBatch]:
        for i, a in enumerate(names[0]):
            yield batch(rows("pair", key[0], a, [(b, int(v)) for b, v in zip(names[1], sums[i], strict=True) if key[1] != key[2] or a < b]))
        yield batch([x for a, heap in heaps.items() for x in rows("term", key[0], a, [(t, -v) for v, t in heap])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, sums, heaps = None, None, None, {}
        for (*key, number), f in _cells(batches):
            head = f[f["term"] == ""].sort_values(["member", "source"])
            if key != own:
                if own is not None:
                    yield from told(own, names, sums, heaps)
                own, heaps = key, {}
                names = [head["source"][head["member"] == g].tolist() for g in key[1:]]
                sums = np.zeros(tuple(map(len, names)), np.int64)
            body = f[f["term"] != ""]
            col, terms = pd.factorize(body["term"])
            total = np.zeros(len(terms), np.int64)
            total[col] = body["total"]
            tiles, none = [], []
            for g, side in zip(key[1:], names, strict=True):
                of = head[head["member"] == g]
                count = np.zeros((len(side), len(terms)), np.int64)
                mine = (body["member"] == g).to_numpy()
                count[pd.Index(side).get_indexer(body["source"][mine]), col[mine]] = body["n"][mine]
                tiles.append((count, shares(count + smooth, of["size"].to_numpy()[:, None])))
                none.append(shares(np.full(len(of), smooth), of["size"].to_numpy()))
            absent = (int(head["v"].iloc[0]) if number == 0 else 0) - len(terms)  # terms that neither side has: over all blocks, v less those seen
            sums += pair_sums(tiles[0][1], tiles[1][1]) + absent * np.abs(none[0][:, None] - none[1])
            if key[1] == key[2] and len(terms):
                count, p = tiles[0]
                lift = np.where(count > 0, p - shares(total + smooth, head["lang_size"].to_numpy()[:1]), 0)
                for i, a in enumerate(names[0]):
                    heaps[a] = heapq.nsmallest(top, [*heaps.get(a, []), *best_terms(lift[i], np.asarray(terms, object), top)], key=lambda x: (x[0], x[1].encode()))
        if own is not None:
            yield from told(own, names, sums, heaps)

    return run


def source_divergence(documents: DataFrame, least: int = LEAST, smooth: int = SMOOTH, top: int = TOP, block: int = BLOCK, groups: int = GROUPS, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by divergence, and the terms a source has above its language."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = kept_counts(documents, least, held)
    every = Window.partitionBy("lang")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(F.col("lead") & (F.col("term") != "")).alias("v"))
    own = own.select("lang", "source", "n", F.sum("v").over(every).alias("v"), F.sum("n").over(every).alias("all"), F.row_number().over(every.orderBy("source")).alias("k"), F.count(F.lit(1)).over(every).alias("g"))
    size = lambda n: (F.col(n) + F.lit(smooth) * F.col("v")).alias({"n": "size", "all": "lang_size"}[n])
    own = written(own.select("lang", "source", "v", size("n"), size("all"), F.ceil(F.greatest(F.col("v"), F.lit(1)) / block).alias("blocks"), F.floor((F.col("k") - 1) / groups).cast("int").alias("member"), F.ceil(F.col("g") / groups).cast("int").alias("members")), "sources")
    heads = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"term": F.lit(""), "n": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    body = kept.where("term <> ''").join(broadcast_if(own, own.count(), 20_000), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    cells = heads.unionByName(body, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("members") - 1)))
    cells = cells.select("lang", F.least("member", "other").alias("one"), F.greatest("member", "other").alias("two"), "block", "source", "term", "n", "total", "v", "size", "lang_size", "member")
    cells = cells.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)
    got = cells.mapInArrow(_compared(top, smooth), "part string, lang string, source string, item string, value long")
    got = written(got, "divergence")
    pairs = got.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(got.where("part = 'term'"), "term").where(F.col("rank") <= top))


def op12_divergence(documents: DataFrame) -> DataFrame:
    return source_divergence(documents)


ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text from documents),
r as (select row_number() over () as r, * from d),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from r),
k as (select lang, term from w group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
gt as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gn as (select lang, source, sum(n) as size from gt group by all),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (size + 5 * v) as p from gt join gn using (lang, source) join v using (lang)),
lt as (select lang, term, sum(n) as n from gt group by all),
ln as (select lang, sum(n) as size from lt group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n::hugeint + 5)) // (size::hugeint + 5 * v) as q from lt join ln using (lang) join v using (lang)),
pv as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 50
"""
