"""Command lines over the operators: python -m sparktriage.cli <command> ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import baseline, decisions, evaluation, features, rules, scoring, screening, slices, strategies, validation
from .sources import files, transactions
from .sources.tables import written


def validate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The seven checks of a transaction file; an error names every failure."""
    tx = transactions.read_csv(spark, a.transactions)
    report = validation.validation_report(tx, validation.accounts_universe(tx), required=transactions.COLUMNS, rows=a.rows, n_accounts=a.accounts, tolerance=a.tolerance, ratio=a.ratio, ratio_tolerance=a.ratio_tolerance)
    validation.gate(report)
    return report


def run_baseline(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Verify the frozen files, run every case, check that each has one result, write them."""
    if a.manifest:
        files.Manifest(Path(a.manifest), Path(a.root)).verify(spark)
    cases = files.json_lines(spark, a.cases, files.EVAL)
    if a.expected is not None and (n := cases.count()) != a.expected:
        raise ValueError(f"{n} cases; {a.expected} are wanted")
    index = screening.build_index(files.load_records(spark, a.watchlist, a.second))
    labels = files.pattern_labels(files.block_patterns(spark, a.patterns))
    out = baseline.run_baseline(cases.select("case_id", "account_id"), transactions.read_csv(spark, a.transactions), spark.read.parquet(a.overlay), index, labels)
    files.write_parquet(out, a.out)
    done = spark.read.parquet(a.out)
    baseline.require_results(done, cases)
    return done.groupBy("disposition", "decision_reason").agg(F.count(F.lit(1)).alias("n"))


def metrics(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Metrics of a result table against the gold labels; a missing or repeated case is an error."""
    results = spark.read.parquet(a.results)
    if "latency_ms" not in results.columns:
        results = results.withColumn("latency_ms", F.lit(0.0))
    out = evaluation.metrics(evaluation.joined(files.json_lines(spark, a.cases, files.EVAL), results))
    files.write_json_file(out, Path(a.out), "eval_size")
    return out


def phase(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Metrics of a policy's results, with review and override rates and the differences to the baseline's metric file."""
    results = spark.read.parquet(a.results)
    missing = {"latency_ms": 0.0, "cost_usd": 0.0, "tokens_used": 0}
    results = results.withColumns({c: F.lit(v) for c, v in missing.items() if c not in results.columns})
    own = evaluation.metrics(evaluation.joined(files.json_lines(spark, a.cases, files.EVAL), results))
    before = spark.read.json(a.baseline).select("accuracy", "weighted_false_clear")
    told = evaluation.rates(results).select("review_rate", "override_rate", "total_tokens", "total_cost")
    held = before.select(F.col("accuracy").alias("baseline_accuracy"), F.col("weighted_false_clear").alias("baseline_weighted_false_clear"))
    out = own.crossJoin(told).crossJoin(held).crossJoin(evaluation.delta(own, before))  # a row each
    files.write_json_file(out, Path(a.out), "eval_size")
    return out


def identities(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Identity overlay and ground truth of all accounts; an error if a name of the list, letter for letter, would be in the overlay."""
    records = files.load_records(spark, a.watchlist, a.second)
    accounts, given, family = spark.read.parquet(a.accounts).select("account_id"), a.given.split(","), a.family.split(",")
    truth = written(slices.fixtures(accounts, records, given, a.seed), "truth")
    overlay = written(slices.identity_overlay(accounts, given, family, a.countries.split(","), a.seed, records, truth), "overlay")
    screening.require_disjoint(overlay, files.raw_names(records))
    files.write_parquet(overlay, a.overlay_out)
    files.write_ground_truth(truth, Path(a.truth_out), files.Manifest(Path(a.manifest), Path(a.root)) if a.manifest else None)
    return truth.groupBy("match_flavor", "gold_is_match").agg(F.count(F.lit(1)).alias("n"))


def cases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The evaluation set from transactions, overlay, ground truth and patterns, checked, written and frozen."""
    tx = transactions.read_csv(spark, a.transactions)
    overlay, truth = spark.read.parquet(a.overlay), files.read_ground_truth(spark, a.truth)
    accounts = validation.accounts_universe(tx)
    scored = scoring.percentiles(scoring.robust_scores(features.feature_matrix(tx, accounts)))
    fired = rules.all_rules(tx).groupBy(F.col("account").alias("account_id")).agg(F.max("severity").alias("max_sev"), F.min_by("rule_id", F.struct(-F.col("severity"), "ord")).alias("top_rule"))
    state = written(accounts.join(scored, "account_id", "left").join(fired, "account_id", "left"), "state")
    t = slices.Targets() if a.targets is None else slices.Targets(**json.loads(a.targets))
    made = slices.eval_set(truth, state, validation.labelled_senders(tx), files.block_patterns(spark, a.patterns), rules.recent_ids(tx), t, a.seed)
    slices.require_eval_set(made, overlay, t.total)
    ids = F.filter(F.split("relevant_txn_ids", ";"), lambda x: x != "")
    files.write_json_file(made.withColumn("relevant_txn_ids", ids).select(*[c.split(" ")[0] for c in files.EVAL.split(", ")]), Path(a.out), "case_id")
    if a.manifest:
        files.Manifest(Path(a.manifest), Path(a.root)).freeze(Path(a.out), bool(a.again))
    return made.groupBy("case_type", "gold_label").agg(F.count(F.lit(1)).alias("n"))


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Every strategy over the baseline's evidence; agreement of all."""
    held = spark.read.parquet(a.results).withColumnRenamed("disposition", "baseline_disposition").drop("decision_reason")
    cases = files.json_lines(spark, a.cases, files.EVAL).drop("account_id")
    return strategies.compare(held.join(cases, "case_id"), None, a.expected)["agreement"]


def triage(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The policy's decision of every case of a result table, with its reasoning."""
    held = spark.read.parquet(a.results).withColumnRenamed("disposition", "baseline_disposition").drop("decision_reason")
    return decisions.policy(held).select("case_id", "disposition", "decision_reason", "reasoning", "confidence", "human_review", "baseline_disposition")


def inspect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = transactions.inspect(spark, a.transactions, a.n)
    rows = [("column", c) for c in found["columns"]] + [("renamed", f"{x} -> {y}") for x, y in found["renamed"]] + [("row", r) for r in found["rows"]]
    return spark.createDataFrame(rows, "kind string, text string")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparktriage", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, **options):
        c = sub.add_parser(run.__name__.replace("run_", ""), help=(run.__doc__ or "").split(";")[0])
        for name, kind in options.items():
            optional = isinstance(kind, tuple)
            c.add_argument(f"--{name.replace('_', '-')}", required=not optional, type=kind[0] if optional else kind, default=kind[1] if optional else None)
        c.set_defaults(run=run)

    command(validate, transactions=str, rows=int, accounts=int, tolerance=(int, 0), ratio=float, ratio_tolerance=(float, 0.0))
    command(run_baseline, cases=str, transactions=str, overlay=str, patterns=str, watchlist=str, second=(str, None), manifest=(str, None), root=(str, "."), expected=(int, None), out=str)
    command(metrics, cases=str, results=str, out=str)
    command(phase, cases=str, results=str, baseline=str, out=str)
    command(identities, accounts=str, watchlist=str, second=(str, None), given=str, family=str, countries=str, seed=(str, "42"), overlay_out=str, truth_out=str, manifest=(str, None), root=(str, "."))
    command(cases, transactions=str, overlay=str, truth=str, patterns=str, seed=(str, "eval"), targets=(str, None), out=str, manifest=(str, None), root=(str, "."), again=(int, 0))
    command(compare, results=str, cases=str, expected=(int, None))
    command(triage, results=str)
    command(inspect, transactions=str, n=(int, 5))
    for name in ("freeze", "verify"):
        c = sub.add_parser(name)
        c.add_argument("--manifest", required=True)
        c.add_argument("--root", default=".")
        c.add_argument("--force", action="store_true")
        c.add_argument("files", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command in ("freeze", "verify"):
        m = files.Manifest(Path(a.manifest), Path(a.root))
        tables = any(Path(f).is_dir() for f in a.files) or any(k.endswith("/") for k in m.entries())
        spark = spark or (SparkSession.builder.getOrCreate() if tables else None)
        for f in a.files if a.command == "freeze" else ():
            m.freeze(Path(f), a.force, spark)
        if a.command == "verify":
            m.verify(spark)
        return
    a.run(spark or SparkSession.builder.getOrCreate(), a).show(100, truncate=False)


if __name__ == "__main__":
    main()
