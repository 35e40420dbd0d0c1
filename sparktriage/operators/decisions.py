"""Case decisions as column expressions: the decision table, the policy with its explanation, overrides, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT, PCT, REVIEW = 0.90, 0.90, 0.85
# fixed values: the explanations by branch
EXPLANATIONS = {
    1: "Sanctions hit score %.3f ≥ 0.90 threshold. OFAC compliance obligation requires immediate escalation.",
    2: "Critical severity-3 rule(s) fired: %s. High-risk pattern warrants escalation.",
    3: "Anomaly at %.1f%% percentile (robust-z %.2f) — top %.1f%% of account population — combined with severity-%d rule. Deterministic baseline requires the 99.5th-percentile flag; agent escalates at the 90th-percentile when paired with elevated rule evidence.",
    4: "Anomaly at %.1f%% percentile with max rule severity %d. Below escalation threshold but elevated; flagging for human review.",
    5: "No significant risk indicators: anomaly %.1f%% percentile, max rule severity %d. Case clears.",
}


def decision_table(cases: DataFrame) -> DataFrame:
    """cases(max_hit, max_sev, is_flagged) with disposition and decision_reason."""
    critical = (F.coalesce("max_hit", F.lit(0.0)) >= HIT) | (F.coalesce("max_sev", F.lit(0)) == 3)
    elevated = F.coalesce("is_flagged", F.lit(False)) & (F.coalesce("max_sev", F.lit(0)) >= 2)
    reason = F.when(critical, "sanctions_or_critical_rule").when(elevated, "anomaly_plus_elevated_rule").otherwise("clear")
    return cases.withColumn("decision_reason", reason).withColumn("disposition", F.when(F.col("decision_reason") == "clear", "CLEAR").otherwise("ESCALATE"))


def inline_gold(max_hit: Column, max_sev: Column, is_flagged: Column) -> Column:
    escalate = (F.coalesce(max_hit, F.lit(0.0)) >= HIT) | (F.coalesce(max_sev, F.lit(0)) >= 3) | (F.coalesce(is_flagged, F.lit(False)) & (F.coalesce(max_sev, F.lit(0)) >= 2))
    return F.when(escalate, "ESCALATE").otherwise("CLEAR")


def policy(cases: DataFrame) -> DataFrame:
    """cases(max_hit, max_sev, sev3_ids, percentile, score) with branch, disposition, reason, reasoning, confidence, human_review."""
    hit, sev = F.coalesce("max_hit", F.lit(0.0)), F.coalesce("max_sev", F.lit(0))
    pct, z = F.coalesce("percentile", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    branch = F.when(hit >= HIT, 1).when(sev == 3, 2).when((pct >= PCT) & (sev >= 2), 3).when(pct > REVIEW, 4).otherwise(5)
    ids = F.concat(F.lit("['"), F.array_join("sev3_ids", "', '"), F.lit("']"))
    told = {1: (hit,), 2: (ids,), 3: (pct * 100, z, (1 - pct) * 100, sev), 4: (pct * 100, sev), 5: (pct * 100, sev)}
    text = F.format_string(EXPLANATIONS[5], *told[5])
    for k in (4, 3, 2, 1):
        text = F.when(F.col("branch") == k, F.format_string(EXPLANATIONS[k], *told[k])).otherwise(text)
    b = F.col("branch")
    return cases.withColumn("branch", branch).withColumns({
        "disposition": F.when(b <= 3, "ESCALATE").otherwise("CLEAR"),
        "decision_reason": F.when(b <= 2, "sanctions_or_critical_rule").when(b == 3, "agent_anomaly_plus_elevated_rule").otherwise("clear"),
        "reasoning": text, "confidence": F.when(b == 1, 0.99).when(b == 2, 0.95).when(b == 3, 0.78).otherwise(0.88), "human_review": b.isin(3, 4),
    })


def overrides(policy_cases: DataFrame, baseline: DataFrame) -> DataFrame:
    """policy rows with the baseline's disposition and whether it was overridden; a case without a baseline stops the job."""
    b = baseline.select("case_id", F.col("disposition").alias("baseline_disposition"))
    out = policy_cases.join(b, "case_id", "left")
    known = F.when(F.col("baseline_disposition").isNull(), F.raise_error(F.lit("a case has no baseline")).cast("boolean")).otherwise(True)
    return out.where(known).withColumn("agent_override", F.col("disposition") != F.col("baseline_disposition"))


EVIDENCE = "struct<sanctions_hits:array<struct<uid:string,score:double>>,rule_firings:array<struct<rule_id:string,severity:int>>,anomaly_score:struct<score:double,percentile:double,is_flagged:boolean>,baseline_disposition:string,baseline_reason:string>"


def evidence(cases: DataFrame) -> DataFrame:
    """case_id and the five-key bundle as JSON: hits, firings, the score (null if there is none), the baseline's decision."""
    hits = F.coalesce("hits", F.array().cast("array<struct<uid:string,score:double>>"))
    firings = F.coalesce("firings", F.array().cast("array<struct<rule_id:string,severity:int>>"))
    score = F.when(F.col("score").isNotNull(), F.struct("score", "percentile", "is_flagged"))
    bundle = F.struct(hits.alias("sanctions_hits"), firings.alias("rule_firings"), score.alias("anomaly_score"), F.col("disposition").alias("baseline_disposition"), F.col("decision_reason").alias("baseline_reason"))
    return cases.select("case_id", F.to_json(bundle, {"ignoreNullFields": "false"}).alias("evidence"))


def read_evidence(bundles: DataFrame) -> DataFrame:
    """case_id, max_hit, max_sev, sev3_ids, score, percentile, is_flagged, baseline_disposition of each bundle; one that isn't JSON stops the job."""
    e = bundles.select("case_id", F.from_json("evidence", EVIDENCE, {"mode": "FAILFAST"}).alias("e"))
    sev3 = F.transform(F.filter("e.rule_firings", lambda r: r["severity"] == 3), lambda r: r["rule_id"])
    return e.select(
        "case_id", F.array_max(F.transform("e.sanctions_hits", lambda h: h["score"])).alias("max_hit"), F.array_max(F.transform("e.rule_firings", lambda r: r["severity"])).alias("max_sev"),
        sev3.alias("sev3_ids"), "e.anomaly_score.score", "e.anomaly_score.percentile", "e.anomaly_score.is_flagged", "e.baseline_disposition",
    )
