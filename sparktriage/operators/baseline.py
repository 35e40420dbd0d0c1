"""The baseline run: screening, two-hop entity, rules and outlier score of every case in one plan, then the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .decisions import decision_table
from .features import feature_matrix
from .graph import entity_chain
from .rules import all_rules
from .scoring import percentiles, robust_scores
from .screening import best_hits
from .validation import accounts_universe


def evidence_of(cases: DataFrame, tx: DataFrame, overlay: DataFrame, index: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """cases(case_id, account_id) with hits, max_hit, firings, max_sev, sev3_ids, score, percentile, is_flagged.

    A case whose account has no identity stops the job. Scores are those of all accounts; screening and rules are those of
    the cases' accounts.
    """
    own = written(cases.join(overlay.select("account_id", "name", "country"), "account_id", "left"), "cases")
    told = F.concat(F.lit("no identity for account "), F.coalesce("account_id", F.lit("null")))
    own = own.where(F.when(F.col("name").isNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    subjects = own.select("account_id", "name").distinct()
    hits = best_hits(subjects, index).groupBy("account_id").agg(
        F.max("score").alias("max_hit"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "uid", "score"))), lambda h: F.struct(h["uid"].alias("uid"), h["score"].alias("score"))).alias("hits"),
    )
    accounts = subjects.select("account_id")
    legs = tx.join(accounts.withColumnRenamed("account_id", "from_account"), "from_account", "left_semi").unionByName(
        tx.join(accounts.withColumnRenamed("account_id", "from_account"), "from_account", "left_anti").join(accounts.withColumnRenamed("account_id", "to_account"), "to_account", "left_semi").select(*tx.columns)
    )
    fired = all_rules(legs, own.select("account_id", "country").distinct()).join(accounts.withColumnRenamed("account_id", "account"), "account", "left_semi")
    fired = fired.groupBy(F.col("account").alias("account_id")).agg(
        F.max("severity").alias("max_sev"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule_id", "severity"))), lambda r: F.struct(r["rule_id"].alias("rule_id"), r["severity"].alias("severity"))).alias("firings"),
    )
    scored = percentiles(robust_scores(feature_matrix(tx, accounts_universe(tx))))
    out = own.join(hits, "account_id", "left").join(fired, "account_id", "left").join(scored, "account_id", "left")
    if chain is not None:
        out = out.join(chain.select("account_id", "hop1", "hop2", "pattern_label"), "account_id", "left")
    sev3 = F.transform(F.filter("firings", lambda r: r["severity"] == 3), lambda r: r["rule_id"])
    return out.withColumn("sev3_ids", F.coalesce(sev3, F.array().cast("array<string>")))


def run_baseline(cases: DataFrame, tx: DataFrame, overlay: DataFrame, index: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Every case with its evidence, disposition and reason, once each."""
    chain = entity_chain(tx, cases.select("account_id"), overlay, patterns) if patterns is not None else None
    return decision_table(evidence_of(cases, tx, overlay, index, chain))


def require_results(results: DataFrame, cases: DataFrame) -> None:
    """ValueError unless there is one result a case."""
    n, m = results.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("c")).first(), cases.count()
    if (n["n"], n["c"]) != (m, m):
        raise ValueError(f"{n['n']} results with {n['c']} ids for {m} cases")
