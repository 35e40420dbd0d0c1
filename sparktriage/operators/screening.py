"""Watch-list screening: a flat name index, exact and fuzzy passes, the best hit of each list entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import best_of_both, jaro_winkler_pairs, last_token, letter_counts, normalize_name, pair_bounds, score_bounds, score_udf, starts, token_sort_pairs
from ..functions.nearkeys import letter_set, near_keys

LIMIT, COLLIDE = 0.85, 0.90
MOST_LISTED = 50_000  # spellings a block
MOST_LETTERS = 4096  # kinds of letters with counts that are told apart by how common they are


def build_index(records: DataFrame) -> DataFrame:
    """uid, norm, kind, list_name, seq: one row a spelling of a record; a canonical spelling wins over an equal alias."""
    if records.isEmpty():
        raise ValueError("the watch-list has no record")
    names = F.concat(F.array("canonical_name"), F.coalesce("aka_names", F.array().cast("array<string>")))
    rows = records.select("uid", "list_name", F.posexplode(names).alias("n", "raw")).withColumn("norm", normalize_name(F.col("raw"))).where("norm <> ''")
    first = Window.partitionBy("uid", "norm").orderBy("n")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    kind = F.when(F.col("n") == 0, "canonical").otherwise("alias")
    return rows.select("uid", "norm", kind.alias("kind"), "list_name", F.concat_ws(":", "uid", F.lpad(F.col("n").cast("string"), 6, "0")).alias("seq"))


def screen_exact(subjects: DataFrame, index: DataFrame) -> DataFrame:
    s = subjects.withColumn("norm", normalize_name(F.col("name"))).where("norm <> ''")
    return s.join(index, "norm").select("account_id", "name", "uid", "list_name", F.lit(1.0).alias("score"), F.lit("exact").alias("scorer"), "kind", "seq")


def _possible(limit: float):
    """Of batches of pairs, those that the letters they share and their common start don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lo in range(0, len(frame), 8192):
                part = frame.iloc[lo : lo + 8192]
                yield part[pair_bounds(part["norm"].tolist(), part["other"].tolist()) >= limit]

    return run


def _scored(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lo in range(0, len(frame), 8192):
                part = frame.iloc[lo : lo + 8192]
                a, b = part["norm"].tolist(), part["other"].tolist()
                jw, ts = jaro_winkler_pairs(a, b), token_sort_pairs(a, b)
                yield part.assign(jw=jw, ts=ts)[np.maximum(jw, ts) >= limit]

    return run


def _letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"letters": [sorted(letter_set(x)) for x in frame.iloc[:, 0]]})


def _keyed(held, limit: float, most: int, first: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = held.value
        for frame in batches:
            for lo in range(0, len(frame), 512):
                part = frame.iloc[lo : lo + 512]
                order = (sorted(letter_set(x), key=lambda t: (place.get(t, -1), t)) for x in part.iloc[:, 0])
                yield part.assign(keys=[near_keys(x, own, limit, most, first) for x, own in zip(part.iloc[:, 0], order, strict=True)])

    return run


def candidate_pairs(names: DataFrame, listed: DataFrame, limit: float = LIMIT) -> DataFrame:
    """norm, other: pairs of distinct names and listed spellings with an equal key (functions.nearkeys) whose letters allow the limit (over 0).

    Every pair within the limit is one. Names come to the list by an equi-join on 64-bit keys, whose hot ones Spark splits. The letters' order comes from the list's MOST_LETTERS commonest letters with counts, all others being the rarest.
    """
    if limit <= 0:
        raise ValueError("every pair scores 0 or more: best_scores goes through all of them")
    spark = names.sparkSession
    names, listed = names.select("norm").distinct(), listed.select("other").distinct()
    common = listed.mapInPandas(_letters, "letters array<string>").select(F.explode("letters").alias("t")).groupBy("t").count()
    common = common.orderBy(F.desc("count"), "t").limit(MOST_LETTERS).collect()
    held = spark.sparkContext.broadcast({r.t: len(common) - i for i, r in enumerate(common)})
    size = lambda df: df.select(F.max(F.length(df.columns[0])))
    own, other = (r[0] or 0 for r in size(names).unionAll(size(listed)).collect())
    a = names.mapInPandas(_keyed(held, limit, other, True), "norm string, keys array<long>").select("norm", F.explode("keys").alias("key"))
    b = listed.mapInPandas(_keyed(held, limit, own, False), "other string, keys array<long>").select("other", F.explode("keys").alias("key"))
    met = a.join(b, "key").select("norm", "other")
    return met.mapInPandas(_possible(limit), "norm string, other string").distinct()


def near_names(names: DataFrame, listed: DataFrame, limit: float = LIMIT) -> DataFrame:
    """norm, other, jw, ts: pairs of distinct names and listed spellings whose better score is at least the limit. It runs jobs at once."""
    found = candidate_pairs(names, listed, limit)
    return found.mapInPandas(_scored(limit), "norm string, other string, jw double, ts double")


def screen_fuzzy(subjects: DataFrame, index: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Hits of at least the limit, with the better scorer; distinct names are scored once, whoever bears them."""
    s = subjects.withColumn("norm", normalize_name(F.col("name"))).where("norm <> ''")
    scored = near_names(s, index.select(F.col("norm").alias("other")), limit)
    scored = scored.withColumn("score", F.greatest("jw", "ts")).withColumn("scorer", F.when(F.col("jw") >= F.col("ts"), "jaro_winkler").otherwise("token_sort_ratio"))
    hits = scored.join(index.withColumnRenamed("norm", "other"), "other").join(s, "norm")
    return hits.select("account_id", "name", "uid", "list_name", "score", "scorer", "kind", "seq")


def _best(held, floor: float):
    """Batches of names against the listed block, branch and bound: spellings in the order of their bounds, until a bound is under the best score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, uids, alphabet, counts, size, start = held.value
        turn = {u: i for i, u in enumerate(sorted(set(uids), key=lambda u: (u is None, u)))}
        turn = [turn[u] for u in uids]
        for frame in batches:
            for lo in range(0, len(frame), 256):
                own = frame["norm"].iloc[lo : lo + 256].tolist()
                bound = score_bounds(letter_counts(own, alphabet), np.array([len(x) for x in own]), starts(own, -1), counts, size, start)
                score, at, width = np.full(len(own), -1.0), np.zeros(len(own), np.int64), 32
                live = np.arange(len(own))
                while len(live):
                    width = min(width, len(listed))
                    top = np.argpartition(-bound[live], width - 1, axis=1)[:, :width]
                    over = np.take_along_axis(bound[live], top, 1) >= np.maximum(score[live], floor)[:, None]
                    i, j = np.nonzero(over)
                    row, col = live[i], top[i, j]
                    got = best_of_both([own[k] for k in row], [listed[k] for k in col]) if len(row) else np.zeros(0)
                    for r, c, v in zip(row.tolist(), col.tolist(), got.tolist(), strict=True):
                        if v > score[r] or v == score[r] and turn[c] < turn[at[r]]:
                            score[r], at[r] = v, c
                    bound[live[:, None], top] = -1  # done with
                    live = live[bound[live].max(1) >= np.maximum(score[live], floor)]
                    width *= 4
                found = score >= floor
                yield pd.DataFrame({"norm": np.array(own, object)[found], "score": score[found], "uid": [uids[k] for k in at[found]]})

    return run


def best_scores(names: DataFrame, records: DataFrame, floor: float = 0.0, most: int = MOST_LISTED) -> DataFrame:
    """norm, score, uid: the best score of each name against every spelling of every record (ties: the smaller uid).

    The list comes to the tasks in blocks of at most `most` spellings, of which the driver holds one at a time; one row a name and
    block leaves a task. Scores under the floor are not looked for; a name without any has score 0 and no uid. It runs jobs at once.
    """
    spark = names.sparkSession
    index = build_index(records).groupBy(F.col("norm").alias("other")).agg(F.min("uid").alias("uid"))
    own, out = names.select("norm").distinct(), None
    blocks = max(1, -(-index.count() // most))
    for k in range(blocks):
        part = index.where(F.pmod(F.xxhash64("other"), F.lit(blocks)) == k) if blocks > 1 else index
        if not (rows := [(r.other, r.uid) for r in part.toLocalIterator()]):
            continue
        listed, uids = [list(x) for x in zip(*rows, strict=True)]
        alphabet = {c: i for i, c in enumerate(sorted({ord(c) for x in listed for c in x}))}
        held = spark.sparkContext.broadcast((listed, uids, alphabet, letter_counts(listed, alphabet), np.array([len(x) for x in listed]), starts(listed, -2)))
        found = own.mapInPandas(_best(held, floor), "norm string, score double, uid string")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("uid").isNull(), "uid")).alias("top"))
    return own.join(best, "norm", "left").select("norm", F.coalesce(-F.col("top.minus"), F.lit(0.0)).alias("score"), "top.uid")


def best_hits(subjects: DataFrame, index: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The best hit of each account and uid (higher score, exact first, then list order), with its rank for the account."""
    hits = screen_exact(subjects, index).unionByName(screen_fuzzy(subjects, index, limit))
    order = [F.desc("score"), (F.col("scorer") != "exact").cast("int"), "seq"]
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("account_id", "uid").orderBy(*order))).where("k = 1").drop("k")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("account_id").orderBy(*order, "uid")))


def surname_collisions(names: DataFrame, listed: DataFrame, limit: float = COLLIDE) -> DataFrame:
    """Names that score at least the limit against a listed name with the same last token."""
    a = names.select(F.col("norm")).distinct().withColumn("last", last_token(F.col("norm")))
    b = listed.select(F.col("norm").alias("other")).distinct().withColumn("last", last_token(F.col("other")))
    hit = a.join(b, "last").where(score_udf("norm", "other") >= limit)
    return hit.select("norm").distinct()


def require_disjoint(overlay: DataFrame, names: DataFrame) -> None:
    """ValueError if a name of the overlay is, letter for letter, a raw name of the list."""
    if both := overlay.select("name").intersect(names.select("name")).limit(5).collect():
        raise ValueError(f"overlay names on the list: {', '.join(r.name for r in both)}")
