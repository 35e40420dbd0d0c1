"""Benchmark decontamination: a prefix-filtered set join of word shingles, exact over item-sized windows.

A document can hold a window of an item only if it holds every shingle of it, so one necessary prefix shingle a window is
enough: the rarest by its frequency in the whole corpus. One pass tokenises the documents and keeps the places at which
shingles of the benchmark stand; all else comes from that table. Places of prefix shingles propose window starts
(positional bound: the start is not before the text; length bound: the window ends within it); a window is held where all
its shingles stand at their places, and as each was compared word by word, that is exact. Windows with a shingle that
the corpus lacks are never proposed. All steps are DataFrame operations.

Defined results: null or empty texts have no words, no hits, and the digest of the empty string; items without words
have no window; an item of fewer words than `size` is one window; repeated items share windows and each counts by its
id; repeated rows of a document (same doc_id) are counted row by row, null doc_ids as well; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if, fresh, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same words with every character outside them named by itself: the JVM looks each up in a bit set, at a fifth of the time
NO_WORD = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z")
FAST_WORD = f"[^{NO_WORD}]++"
SIZE, SHINGLE = 10, 3
MOST_BROADCAST = 500_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the built-in lower() does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(FAST_WORD), F.lit(0))


def row_key() -> Column:
    """What names a document row: its id and a hash of its text; nulls inside are equal to each other."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, window: words joined by blanks) of every item, each window once an item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size) + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, size), " "))).alias("window")).distinct()


def window_shingles(windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """window, len, off, k, s: the shingles (k words joined by blanks) of each window; k is `width`, or all words of a shorter window."""
    w = windows.select("window", F.split("window", " ").alias("w")).withColumn("len", F.size("w")).withColumn("k", F.least("len", F.lit(width)))
    w = w.select("window", "len", "k", "w", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
    return w.select("window", "len", "off", "k", F.array_join(F.slice("w", F.col("off") + 1, F.col("k")), " ").alias("s"))


def shingle_places(documents: DataFrame, listed: DataFrame, ks: list[int], n_listed: int) -> DataFrame:
    """row, n, at, s, last: each place where a listed shingle (k, s) stands, and one line a document row with `last` set.

    The one pass over the texts. Shingles meet by hash and are then compared as words.
    """
    ks = ks or [1]
    names = [f"w{i}" for i in range(max(ks))]
    docs = documents.select(row_key().alias("row"), words(F.col("text")).alias("w"))
    shifted = F.arrays_zip(*[(F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))) if i else F.col("w")).alias(c) for i, c in enumerate(names)])
    each = docs.select("row", F.size("w").alias("n"), F.posexplode_outer(shifted).alias("at", "z")).select("row", "n", "at", *[F.col("z")[c].alias(c) for c in names])
    end = F.col("at").isNull() | (F.col("at") == F.col("n") - 1)
    if len(ks) == 1:
        each = each.withColumn("k", F.lit(ks[0])).withColumn("last", end)
    else:
        each = each.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("last", end & (F.col("k") == ks[0]))
    own = [F.when(F.col("k") > i, F.col(c)) for i, c in enumerate(names)]
    held = listed.select(F.xxhash64("k", *[F.try_element_at(F.split("s", " "), F.lit(i + 1)) for i in range(len(names))]).alias("h"), "s")
    text = F.concat_ws(" ", *own)
    met = (F.xxhash64("k", *own) == F.col("h")) & (text >= F.col("s")) & (text <= F.col("s"))  # an equality here would become a wide join key
    return each.join(broadcast_if(held, n_listed, MOST_BROADCAST), met, "left").where("s is not null or last").select("row", "n", "at", "s", "last")


def contamination(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document row: row (own key), doc_id, n_words, n_hit, and hit item ids as a sorted array of strings."""
    pairs = written(item_windows(items, size), "pairs")
    parts = written(window_shingles(pairs.select("window").distinct()), "parts")
    n_pairs, (n_parts, ks) = pairs.count(), parts.agg(F.count(F.lit(1)), F.collect_set("k")).first()  # SHINGLE values of k at most
    places = written(shingle_places(documents, parts.select("k", "s").distinct(), sorted(ks), n_parts), "places")

    met = places.where("s is not null")
    ranked = parts.join(met.groupBy("s").agg(F.count(F.lit(1)).alias("freq")), "s", "left")
    prefix = ranked.groupBy("window", "len").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "s")).alias("p"))
    prefix = prefix.where("p.freq > 0").select("window", "len", "m", F.col("p.s").alias("s"), F.col("p.off").alias("off"))
    proposed = met.join(broadcast_if(prefix, n_parts, MOST_BROADCAST), "s").withColumn("start", F.col("at") - F.col("off"))
    proposed = proposed.where("start >= 0 and start + len <= n").select("row", "start", "window", "len", "m").distinct()
    due = proposed.join(broadcast_if(parts.select("window", "off", "s"), n_parts, MOST_BROADCAST), "window").withColumn("at", F.col("start") + F.col("off"))
    whole = due.join(met.select("row", "at", "s").distinct(), ["row", "at", "s"]).groupBy("row", "start", "window", "len", "m").agg(F.count(F.lit(1)).alias("c"))
    held = written(whole.where("c = m").select("row", "start", "window", "len"), "held")

    spans = held.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))
    more = lambda a, s: F.struct((a["covered"] + F.greatest(s["stop"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("covered"), F.greatest(a["reach"], s["stop"]).alias("reach"))
    covered = spans.select("row", F.aggregate("spans", zero, more)["covered"].cast("long").alias("n_hit"))
    found = held.select("row", "window").distinct().join(broadcast_if(pairs, n_pairs, MOST_BROADCAST), "window")
    ids = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = places.where("last").select("row", F.col("row.id").alias("doc_id"), F.col("n").cast("long").alias("n_words")).join(covered.join(ids, "row"), "row", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", none)})


def drop_contaminated(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns."""
    bad = fresh(documents, "bad")
    rows = contamination(documents, items, size).where("n_hit > 0").select(F.col("row").alias(bad)).distinct()
    return documents.join(rows, row_key() == F.col(bad), "left_anti")


def op1_decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(documents, items)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, l.n, array_to_string(w[s:s + l.n - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM w) d, (SELECT DISTINCT n FROM bw) l WHERE s + l.n - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
