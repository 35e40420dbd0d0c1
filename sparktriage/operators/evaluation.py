"""Evaluation of dispositions: the bijective join, weighted false clears, precision and recall, latencies, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_weight() -> Column:
    band = F.col("severity_band")
    kind = F.when((F.col("case_type") == "sanctions_hit") | (F.col("conflict_type") == "rule3_no_anomaly"), 3).when(F.col("case_type") == "typology", 2).otherwise(1)
    return F.when(band.isin(1, 2, 3), band).otherwise(kind)


def joined(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with their results; a missing, extra or repeated case stops the job."""
    one = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.first("disposition").alias("disposition"), F.first("latency_ms").alias("latency_ms"))
    left = cases.withColumn("__c", F.lit(1))
    both = left.join(one, "case_id", "full_outer")
    odd = F.col("__c").isNull() | F.col("n").isNull() | (F.col("n") != 1)
    held = F.when(odd, F.raise_error(F.lit("cases and results don't match one to one")).cast("boolean")).otherwise(True)
    return both.where(held).drop("__c", "n")  # a filter: whatever columns are read, every row is checked


def joined_leniently(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with the results that there are; a case without one has a null disposition and counts as neither cleared nor right."""
    return cases.join(results.select("case_id", "disposition"), "case_id", "left")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(pairs: DataFrame) -> DataFrame:
    """One row of all metrics in one aggregate."""
    w, escalated, gold = case_weight().cast("double"), F.col("disposition") == "ESCALATE", F.col("gold_label") == "ESCALATE"
    hit, near = F.col("case_type") == "sanctions_hit", F.col("case_type") == "sanctions_near_miss"
    a = pairs.agg(
        F.avg((F.col("disposition") == F.col("gold_label")).cast("double")).alias("accuracy"),
        F.coalesce(F.sum(F.when(gold & ~escalated, w)), F.lit(0.0)).alias("fc"), F.coalesce(F.sum(F.when(gold, w)), F.lit(0.0)).alias("all"),
        F.count_if(hit & escalated).alias("tp"), F.count_if(near & escalated).alias("fp"), F.count_if(hit & ~escalated).alias("fn"),
        F.percentile("latency_ms", 0.5).alias("latency_p50"), F.percentile("latency_ms", 0.95).alias("latency_p95"), F.count(F.lit(1)).alias("eval_size"),
    )
    r = lambda c: F.round(c, 6)
    return a.select(
        r(F.col("accuracy")).alias("accuracy"), r(_ratio(F.col("fc"), F.col("all"))).alias("weighted_false_clear"),
        r(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("sanctions_precision"), r(_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("sanctions_recall"),
        r(F.col("latency_p50")).alias("latency_p50"), r(F.col("latency_p95")).alias("latency_p95"), "eval_size",
    )


def delta(phase: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of two one-row metric frames."""
    b = baseline.select(F.col("accuracy").alias("a"), F.col("weighted_false_clear").alias("f"))
    return phase.crossJoin(b).select(F.round(F.col("accuracy") - F.col("a"), 6).alias("delta_accuracy"), F.round(F.col("weighted_false_clear") - F.col("f"), 6).alias("delta_false_clear"))


def rates(rows: DataFrame) -> DataFrame:
    """One row: override and review rates, mean, least and largest latency, cost and token sums, and whether all are zero."""
    return rows.agg(
        F.round(F.avg(F.col("agent_override").cast("double")), 6).alias("override_rate"), F.round(F.avg(F.col("human_review").cast("double")), 6).alias("review_rate"),
        F.round(F.avg("latency_ms"), 6).alias("latency_mean"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.bool_and(F.col("cost_usd") == 0), F.lit(True)).alias("zero_cost"), F.coalesce(F.bool_and(F.col("tokens_used") == 0), F.lit(True)).alias("zero_tokens"), F.count(F.lit(1)).alias("n"),
    )


def framework_metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """A row a framework: accuracy over its results, weighted false clears over all cases to escalate (missing results clear nothing)."""
    gold = cases.select("case_id", "gold_label", case_weight().cast("double").alias("w"))
    met = results.join(gold, "case_id", "left")
    clear = F.when((F.col("gold_label") == "ESCALATE") & (F.col("disposition") == "CLEAR"), F.col("w"))
    own = met.groupBy("framework").agg(F.avg(F.coalesce((F.col("disposition") == F.col("gold_label")).cast("double"), F.lit(0.0))).alias("a"), F.coalesce(F.sum(clear), F.lit(0.0)).alias("fc"), F.count(F.lit(1)).alias("eval_size"))
    every = gold.agg(F.coalesce(F.sum(F.when(F.col("gold_label") == "ESCALATE", F.col("w"))), F.lit(0.0)).alias("all"))
    both = own.crossJoin(F.broadcast(every))  # one row
    return both.select("framework", F.round("a", 6).alias("accuracy"), F.round(_ratio(F.col("fc"), F.col("all")), 6).alias("weighted_false_clear"), "eval_size")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
