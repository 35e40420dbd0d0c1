"""Data-quality gate: seven checks as rows of one aggregate, and a driver-side gate that names every failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validation_report(tx: DataFrame, accounts: DataFrame, *, required: tuple[str, ...], rows: int, n_accounts: int, tolerance: int, ratio: float, ratio_tolerance: float) -> DataFrame:
    """check, passed, actual. One pass over the transactions, one count of the accounts."""
    if set(accounts.columns) != {"account_id"}:
        raise ValueError("accounts has the one column account_id")
    held = set(tx.columns)
    keys = [c for c in ("from_account", "to_account", "amount_received") if c in held]
    nulls = lambda cs: sum((F.count_if(F.col(c).isNull()) for c in cs), F.lit(0).cast("long"))
    flag = F.col("is_laundering") if "is_laundering" in held else F.lit(None).cast("int")
    one = tx.agg(
        nulls(keys).alias("keys"), nulls(tx.columns).alias("nulls"), F.count_if(flag.isNull() | ~flag.isin(0, 1)).alias("odd"),
        F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("ratio"),
    ).crossJoin(accounts.agg(F.count_distinct("account_id").alias("accounts")))  # fmt: skip  # one row each
    missing = ",".join(sorted(set(required) - held))
    check = lambda i, name, ok, actual: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("check"), ok.alias("passed"), actual.cast("string").alias("actual"))
    found = F.array(
        check(1, "schema", F.lit(not missing), F.lit(missing)),
        check(2, "no_nulls_in_keys", F.lit(len(keys) == 3) & (F.col("keys") == 0), F.col("keys")),
        check(3, "null_counts", F.col("nulls") == 0, F.col("nulls")),
        check(4, "is_laundering_values", F.lit("is_laundering" in held) & (F.col("odd") == 0), F.col("odd")),
        check(5, "row_count", F.col("n") == rows, F.col("n")),
        check(6, "account_count", F.abs(F.col("accounts") - n_accounts) <= tolerance, F.col("accounts")),
        check(7, "laundering_ratio", F.coalesce(F.abs(F.col("ratio") - ratio) <= ratio_tolerance, F.lit(False)), F.round(F.coalesce("ratio", F.lit(-1.0)), 6)),
    )
    return one.select(F.explode(found).alias("c")).select("c.*")


def gate(report: DataFrame) -> None:
    failed = [f"{r['check']}: {r['actual']}" for r in report.where("not passed").orderBy("ord").collect()]  # seven rows at most
    if failed:
        raise ValueError("; ".join(failed))


def accounts_universe(tx: DataFrame) -> DataFrame:
    sides = tx.select(F.explode(F.array("from_account", "to_account")).alias("account_id"))
    return sides.where("account_id is not null").distinct()


def labelled_senders(tx: DataFrame) -> DataFrame:
    return tx.where("is_laundering = 1").select(F.col("from_account").alias("account_id")).distinct()
