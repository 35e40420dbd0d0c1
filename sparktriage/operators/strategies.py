"""The policy in three forms (columns, SQL text, Arrow batches) behind one registry, and their agreement."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from importlib import metadata
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .decisions import EXPLANATIONS, HIT, PCT, REVIEW, policy
from .evaluation import framework_metrics

FIELDS = ("case_id", "account_id", "disposition", "decision_reason", "reasoning", "confidence", "human_review", "agent_override", "latency_ms", "cost_usd", "tokens_used")
COMPARED = {"disposition": ("disposition",), "reasoning": ("decision_reason", "reasoning"), "human_review": ("human_review",), "override": ("agent_override",)}


class Strategy(Protocol):
    framework_name: str

    def run(self, cases: DataFrame) -> DataFrame: ...


class ColumnStrategy:
    framework_name = "columns"

    def run(self, cases: DataFrame) -> DataFrame:
        return policy(cases).withColumn("agent_override", F.col("disposition") != F.col("baseline_disposition")).select(*FIELDS[:8])


class SqlStrategy:
    """The same policy as SQL text."""

    framework_name = "sql"

    def run(self, cases: DataFrame) -> DataFrame:
        hit, sev, pct = "coalesce(max_hit, 0)", "coalesce(max_sev, 0)", "coalesce(percentile, 0)"
        b = cases.selectExpr("*", f"CASE WHEN {hit} >= {HIT} THEN 1 WHEN {sev} = 3 THEN 2 WHEN {pct} >= {PCT} AND {sev} >= 2 THEN 3 WHEN {pct} > {REVIEW} THEN 4 ELSE 5 END AS b")
        words = " ".join(f"WHEN {k} THEN {text}" for k, text in self.texts(hit, sev, pct).items())
        rows = b.selectExpr(
            "case_id", "account_id", "CASE WHEN b <= 3 THEN 'ESCALATE' ELSE 'CLEAR' END AS disposition",
            "CASE WHEN b <= 2 THEN 'sanctions_or_critical_rule' WHEN b = 3 THEN 'agent_anomaly_plus_elevated_rule' ELSE 'clear' END AS decision_reason",
            f"CASE b {words} END AS reasoning", "CAST(CASE b WHEN 1 THEN 0.99 WHEN 2 THEN 0.95 WHEN 3 THEN 0.78 ELSE 0.88 END AS DOUBLE) AS confidence", "b IN (3, 4) AS human_review", "baseline_disposition",
        )
        return rows.selectExpr(*FIELDS[:7], "disposition <> baseline_disposition AS agent_override")

    @staticmethod
    def texts(hit: str, sev: str, pct: str) -> dict[int, str]:
        own = lambda k, *values: f"format_string('{EXPLANATIONS[k]}', {', '.join(values)})"
        return {
            1: own(1, f"CAST({hit} AS DOUBLE)"), 2: own(2, "concat('[\\'', array_join(sev3_ids, '\\', \\''), '\\']')"),
            3: own(3, f"{pct} * 100", "CAST(coalesce(score, 0) AS DOUBLE)", f"(1 - {pct}) * 100", sev), 4: own(4, f"{pct} * 100", sev), 5: own(5, f"{pct} * 100", sev),
        }


class ArrowStrategy:
    """The same policy over Arrow batches."""

    framework_name = "arrow"

    def run(self, cases: DataFrame) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                hit, sev, pct, z = p["max_hit"].fillna(0.0), p["max_sev"].fillna(0).astype(int), p["percentile"].fillna(0.0), p["score"].fillna(0.0)
                branch = np.select([hit.ge(HIT), sev.eq(3), pct.ge(PCT) & sev.ge(2), pct.gt(REVIEW)], [1, 2, 3, 4], 5)
                told = {1: lambda i: (hit[i],), 2: lambda i: ("['" + "', '".join(p["sev3_ids"][i]) + "']",), 3: lambda i: (pct[i] * 100, z[i], (1 - pct[i]) * 100, sev[i]), 4: lambda i: (pct[i] * 100, sev[i]), 5: lambda i: (pct[i] * 100, sev[i])}
                out = p[["case_id", "account_id"]].copy()
                out["disposition"] = np.where(branch <= 3, "ESCALATE", "CLEAR")
                out["decision_reason"] = np.select([branch <= 2, branch == 3], ["sanctions_or_critical_rule", "agent_anomaly_plus_elevated_rule"], "clear")
                out["reasoning"] = [EXPLANATIONS[b] % told[b](i) for i, b in zip(p.index, branch.tolist(), strict=True)]
                out["confidence"] = np.select([branch == 1, branch == 2, branch == 3], [0.99, 0.95, 0.78], 0.88)
                out["human_review"] = np.isin(branch, (3, 4))
                out["agent_override"] = out["disposition"] != p["baseline_disposition"]
                yield out

        used = cases.select("case_id", "account_id", "max_hit", "max_sev", "percentile", "score", "sev3_ids", "baseline_disposition")
        return used.mapInPandas(each, "case_id string, account_id string, disposition string, decision_reason string, reasoning string, confidence double, human_review boolean, agent_override boolean")


REGISTRY: list[Callable[[], Strategy]] = [ColumnStrategy, SqlStrategy, ArrowStrategy]


def run_one(make: Callable[[], Strategy], cases: DataFrame) -> DataFrame:
    """The rows of one strategy, run to the end and written: what fails fails here. Offline strategies cost nothing and use no token."""
    s = make()
    rows = s.run(cases)
    free = {"latency_ms": F.lit(0.0), "cost_usd": F.lit(0.0), "tokens_used": F.lit(0).cast("long")}
    rows = rows.withColumns({c: v for c, v in free.items() if c not in rows.columns})
    return written(rows.select(*FIELDS).withColumn("framework", F.lit(s.framework_name)), "strategy")


def run_all(cases: DataFrame, registry=None) -> tuple[DataFrame, dict[str, str]]:
    """Union of all strategies' rows in the order of the registry, and the errors of those that failed, while planned or while run. Each is run at once."""
    out, errors = None, {}
    for make in registry or REGISTRY:
        try:
            rows = run_one(make, cases)
        except Exception as e:  # recorded; a failed strategy never turns into a cleared case
            errors[make.framework_name] = f"{type(e).__name__}: {e}"[:2000]
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no strategy ran: {errors}")
    return out, errors


def agreement(results: DataFrame, n: int, errors: dict[str, str] | None = None) -> DataFrame:
    """One row of eight flags over n strategies, and the verdict: all flags hold and no strategy failed. Empty input agrees.

    Fields are compared case by case among the strategies that have the case. Order agrees if every strategy has the same
    cases at the same places in order of id, once each: frames have no order of their own.
    """
    fields = [c for cs in COMPARED.values() for c in cs]
    wide = lambda c: (F.min(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == F.max(F.coalesce(F.col(c).cast("string"), F.lit("\0")))).alias(c)
    per = results.groupBy("case_id").agg(
        F.count_distinct("framework").alias("held"), F.count(F.lit(1)).alias("rows"), *[wide(c) for c in fields],
        F.bool_and(F.col("cost_usd") == 0).alias("cost"), F.bool_and(F.col("tokens_used") == 0).alias("tokens"),
    )
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    both = lambda cs: reduce(lambda a, b: a & b, [F.col(c) for c in cs])
    flags = per.agg(
        F.count(F.lit(1)).alias("n_cases"), *[every(both(cs)).alias(f"{k}_agree") for k, cs in COMPARED.items()], every(F.col("held") == n).alias("case_ids_agree"),
        every((F.col("held") == n) & (F.col("rows") == n)).alias("case_order_agree"), every(F.col("cost")).alias("costs_zero"), every(F.col("tokens")).alias("tokens_zero"),
    )
    return flags.withColumn("passed", both(flags.columns[1:]) & F.lit(not errors))


def disagreements(results: DataFrame) -> DataFrame:
    """case_id, field, values (framework=value, in order) of every compared field in which a case's strategies differ."""
    fields = [c for cs in COMPARED.values() for c in cs]
    each = results.select("case_id", "framework", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("f"))
    told = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "framework", F.coalesce("f.value", F.lit("null"))))), "; ")
    return each.groupBy("case_id", "f.field").agg(F.count_distinct(F.coalesce("f.value", F.lit("\0"))).alias("k"), told.alias("values")).where("k > 1").drop("k")


CHECKS = ("count", "duplicates", "framework", "empty", "tokens", "cost", "missing", "extra")


def invariants(results: DataFrame, cases: DataFrame, expected: str | None = None) -> DataFrame:
    """framework, check, bad: how many rows or cases break each of the eight invariants of a strategy's result.

    The count is held against the cases; `expected` is the one tag that a single strategy's rows must bear.
    """
    n = F.broadcast(cases.agg(F.count(F.lit(1)).alias("n")))  # one row
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tag = F.lit(expected) if expected else F.col("framework")
    per = results.groupBy("framework").agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("case_id")).alias("duplicates"), F.count_if(F.col("framework") != tag).alias("framework_bad"),
        F.count_if(blank(F.col("case_id")) | blank(F.col("account_id"))).alias("empty"), F.count_if(F.col("tokens_used") != 0).alias("tokens"), F.count_if(F.col("cost_usd") != 0).alias("cost"),
    ).crossJoin(n)
    tags = results.select("framework").distinct()
    want = cases.select("case_id").distinct().crossJoin(F.broadcast(tags))  # a few strategies by name
    missing = want.join(results, ["case_id", "framework"], "left_anti").groupBy("framework").agg(F.count(F.lit(1)).alias("missing"))
    extra = results.join(cases, "case_id", "left_anti").groupBy("framework").agg(F.count(F.lit(1)).alias("extra"))
    one = per.join(missing, "framework", "left").join(extra, "framework", "left").withColumn("count", F.abs(F.col("rows") - F.col("n")))
    one = one.drop("rows", "n").withColumnRenamed("framework_bad", "tag")
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("check"), F.coalesce(F.col("tag" if c == "framework" else c), F.lit(0)).cast("long").alias("bad")) for i, c in enumerate(CHECKS)])
    return one.select("framework", F.explode(rows).alias("r")).select("framework", "r.ord", "r.check", "r.bad")


def require_invariants(results: DataFrame, cases: DataFrame, framework: str) -> None:
    """ValueError that names the first broken invariant of one strategy's rows."""
    if results.isEmpty():
        raise ValueError(f"{framework}: no results")
    bad = invariants(results, cases, framework).where("bad > 0").orderBy("ord").first()
    if bad:
        raise ValueError(f"{framework}: {bad['check']} ({bad['bad']})")


def compare(cases: DataFrame, registry=None, expected: int | None = None) -> dict:
    """The comparison run: every strategy on its own, its invariants, agreement, metrics, errors. `expected`: how many cases there must be."""
    if expected is not None and (n := cases.count()) != expected:
        raise ValueError(f"{n} cases; {expected} are wanted")
    registry = list(registry or REGISTRY)
    results, errors = run_all(cases, registry)
    broken = invariants(results, cases).where("bad > 0")
    return {"results": results, "errors": errors, "broken": broken, "agreement": agreement(results, len(registry) - len(errors), errors), "disagreements": disagreements(results), "metrics": framework_metrics(results, cases), "versions": versions()}


def versions(packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict[str, str]:
    """Installed versions; unknown if a package isn't there."""
    out = {}
    for p in packages:
        try:
            out[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            out[p] = "unknown"
    return out


def prior_accuracy(file: Path) -> float:
    """The accuracy of an earlier phase's metric file; 0 if it isn't there."""
    return float(json.loads(file.read_text()).get("accuracy", 0.0)) if file.exists() else 0.0
