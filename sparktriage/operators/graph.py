"""Two-hop counterparty resolution on an undirected edge frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .wholehops import with_hop2

HOP2 = 50


def edges(tx: DataFrame) -> DataFrame:
    """account, cp in both directions, distinct, without self-loops; one scan."""
    both = F.array(F.struct(F.col("from_account").alias("account"), F.col("to_account").alias("cp")), F.struct(F.col("to_account").alias("account"), F.col("from_account").alias("cp")))
    return tx.where("from_account <> to_account").select(F.explode(both).alias("e")).select("e.*").distinct()


def adjacency(e: DataFrame) -> DataFrame:
    return e.groupBy("account").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_set("cp")).alias("neighbours"))


def _first_ids(e: DataFrame, n: int) -> DataFrame:
    """cp, nr: the first n ids of the graph in order, numbered from 0."""
    return e.select("cp").distinct().orderBy("cp").limit(n).agg(F.array_sort(F.collect_list("cp")).alias("ids")).select(F.posexplode("ids").alias("nr", "cp"))


def _hop2_marked(e: DataFrame, start: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """account, nrs: the places of first ids at two steps, ascending. A set of them is `words` longs, so two steps are bit_or over the neighbours' sets."""
    names = [f"w{i}" for i in range(words)]
    bit = lambda i: F.when(F.expr(f"nr div 64 = {i}"), F.expr("shiftleft(1L, nr % 64)")).otherwise(F.lit(0).cast("long"))
    own = e.join(F.broadcast(first), "cp").groupBy("account").agg(*[F.bit_or(bit(i)).alias(w) for i, w in enumerate(names)])
    far = start.join(own.withColumnRenamed("account", "cp"), "cp").groupBy("account").agg(*[F.bit_or(w).alias(w) for w in names])
    near = own.select("account", *[F.col(w).alias(f"n{w}") for w in names])
    self_ = F.broadcast(first.select(F.col("cp").alias("account"), "nr"))
    left = far.join(near, "account", "left").join(self_, "account", "left")
    kept = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"n{w}", F.lit(0).cast("long")).bitwiseOR(F.coalesce(bit(i), F.lit(0).cast("long"))))) for i, w in enumerate(names)]
    listed = lambda i, w: F.filter(F.sequence(F.lit(64 * i), F.lit(64 * i + 63)), lambda k: F.getbit(w, k % 64) == 1)
    return left.select("account", F.concat(*[listed(i, w) for i, w in enumerate(kept)]).alias("nrs"))


def hop2(e: DataFrame, accounts: DataFrame, most: int | None = HOP2, words: int = 4) -> DataFrame:
    """account, cp: the first `most` accounts in order of id at two steps, without the account and its neighbours. None: all of them, by tiles of sets (`wholehops.py`).

    Where `most` of them are among the first 64 x words ids of the graph, as in dense graphs, those are the answer: sets of bits find them, one row an edge.
    The other accounts list their neighbours' neighbours. Of a neighbour's list in order of id, all but degree + 1 entries are at two steps, so the
    first most + degree + 1 are enough, whatever the neighbour's own degree: a hub gives each asker a short list.
    """
    if most is None:
        return with_hop2(accounts.select("account_id").distinct(), e).select(F.col("account_id").alias("account"), F.explode("hop2").alias("cp"))
    first = _first_ids(e, 64 * words)
    start = e.join(accounts.select(F.col("account_id").alias("account")).distinct(), "account", "left_semi")
    marked = _hop2_marked(e, start, first, words).where(F.size("nrs") >= most)
    quick = marked.select("account", F.explode(F.slice("nrs", 1, most)).alias("nr")).join(F.broadcast(first), "nr").select("account", "cp")

    start = start.join(marked.select("account"), "account", "left_anti")
    start = start.withColumn("upto", F.count(F.lit(1)).over(Window.partitionBy("account")) + most + 1)
    listed = e.select(F.col("account").alias("cp"), F.col("cp").alias("far"), F.row_number().over(Window.partitionBy("account").orderBy("cp")).alias("nr"))
    met = start.join(listed, (start.cp == listed.cp) & (listed.nr <= start.upto)).where("far <> account")
    far = met.select("account", F.col("far").alias("cp")).distinct().join(e, ["account", "cp"], "left_anti")
    order = Window.partitionBy("account").orderBy("cp")
    return quick.unionByName(far.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k"))


def entity_chain(tx: DataFrame, accounts: DataFrame, profiles: DataFrame, labels: DataFrame, most: int | None = HOP2, sep: str | None = None) -> DataFrame:
    """account_id, name, country, kyc_risk, hop1, hop2, pattern_label of each account asked for; hop2 holds the first `most` ids, all with None; with `sep` the lists are strings. The edges are written at once and read by every step."""
    e = written(edges(tx), "edges")
    own = accounts.select("account_id").distinct()
    near = e.join(own.withColumnRenamed("account_id", "account"), "account", "left_semi").groupBy("account").agg(F.array_sort(F.collect_list("cp")).alias("hop1"))
    out = own.join(profiles, "account_id", "left").join(near.withColumnRenamed("account", "account_id"), "account_id", "left").join(labels.withColumnRenamed("label", "pattern_label"), "account_id", "left")
    if most is None:
        out = with_hop2(out, e, sep)
    else:
        far = hop2(e, own, most).groupBy("account").agg(F.array_sort(F.collect_list("cp")).alias("hop2"))
        out = out.join(far.withColumnRenamed("account", "account_id"), "account_id", "left")
    listed = lambda h: F.coalesce(h, F.array().cast("array<string>")) if sep is None else F.coalesce(h if dict(out.dtypes)[h] == "string" else F.array_join(h, sep), F.lit(""))
    return out.select("account_id", F.coalesce("name", F.lit("UNKNOWN")).alias("name"), "country", "kyc_risk", listed("hop1").alias("hop1"), listed("hop2").alias("hop2"), "pattern_label")
