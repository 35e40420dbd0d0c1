"""Frames that the registered queries start from: domain views of the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import accounts_universe
from ..sources.transactions import from_events

# fixed values: a country for each nation key and a risk for each segment
COUNTRIES = ("US", "IR", "PK", "GB", "FR", "KP", "DE", "NG", "JP", "BR", "IN", "CU", "CA", "AU", "ZA", "CH", "SE", "VE", "NL", "ES", "IT", "MM", "SG", "MX", "PL")
RISKS = {"AUTOMOBILE": "low", "BUILDING": "low", "FURNITURE": "medium", "HOUSEHOLD": "medium", "MACHINERY": "high"}


def tx(spark: SparkSession, d: str) -> DataFrame:
    return from_events(spark, d)


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return accounts_universe(tx(spark, d))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), F.pmod(F.col("c_nationkey"), F.lit(len(COUNTRIES))).cast("int") + 1)
    risk = F.element_at(F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv]), F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("name"), country.alias("country"), risk.alias("kyc_risk"))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """typology, account_id: the types of events an account sent, as typology keys."""
    return tx(spark, d).select(F.upper("payment_format").alias("typology"), F.col("from_account").alias("account_id")).distinct()


def records(spark: SparkSession, d: str) -> DataFrame:
    """Watch-list of the distinct part names; the alias is the reversed name."""
    n = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("canonical_name")).distinct()
    alias = F.array_join(F.reverse(F.split("canonical_name", " ")), " ")
    return n.select(F.concat(F.lit("U-"), F.translate("canonical_name", " ", "_")).alias("uid"), "canonical_name", F.array(alias).alias("aka_names"), F.lit("SDN").alias("list_name"))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """account_id, name: spellings derived from the distinct part names by a fixed rule."""
    n = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct()
    a, b = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    as_ = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("name"))
    made = F.array(as_("same", F.upper("p_name")), as_("turned", F.concat(b, F.lit("  "), a)), as_("ocr", F.translate("p_name", "o", "0")), as_("cut", F.concat(a, F.lit(" "), F.substring(b, 1, 3))))
    return n.select("p_name", F.explode(made).alias("m")).select(F.concat_ws(":", "m.how", "p_name").alias("account_id"), "m.name")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases with evidence, by arithmetic on customer keys, so that every branch and boundary occurs."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("case_id"), k.cast("string").alias("account_id"), k.alias("k"))
    pick = lambda m, *vs: F.element_at(F.array(*vs), F.pmod(F.col("k"), F.lit(m)).cast("int") + 1)
    none = F.lit(None)
    sev = pick(5, none.cast("int"), F.lit(1), F.lit(2), F.lit(3), F.lit(2))
    pct = F.when(F.col("k") % 11 != 0, (F.col("k") * 37 % 1000) / 1000.0)
    kind = pick(4, F.lit("sanctions_hit"), F.lit("sanctions_near_miss"), F.lit("ibm_labeled"), F.lit("typology"))
    c = c.withColumns({
        "max_hit": pick(7, none.cast("double"), F.lit(0.95), F.lit(0.86), F.lit(0.90), none.cast("double"), none.cast("double"), none.cast("double")),
        "max_sev": sev, "percentile": pct, "score": pct * 20.0, "case_type": kind,
        "severity_band": F.when(kind == "ibm_labeled", F.pmod(F.floor(F.col("k") / 4), F.lit(3)).cast("int") + 1),
        "conflict_type": F.when((kind == "typology") & (F.col("k") % 3 == 0), "rule3_no_anomaly"), "gold_label": F.when(F.col("k") % 3 != 1, "ESCALATE").otherwise("CLEAR"),
        "latency_ms": (F.col("k") * 53 % 997) / 10.0,
    })
    ids = F.when(F.col("max_sev") == 3, F.array(F.lit("STRUCT_001"), F.lit("PASSTHROUGH_001"))).otherwise(F.array().cast("array<string>"))
    return c.withColumn("sev3_ids", ids).withColumn("is_flagged", F.col("percentile") >= 0.995).drop("k")


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """account_id, name, country, kyc_risk of every account: a spelling of the part name with the account's number."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("account_id"), "p_name")
    k = F.col("account_id").cast("long")
    a, b = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    name = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat(b, F.lit("  "), a)).when(k % 4 == 2, F.translate("p_name", "o", "0")).otherwise(F.concat(a, F.lit(" "), F.substring(b, 1, 3)))
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (k % len(COUNTRIES)).cast("int") + 1)
    risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3).cast("int") + 1)
    return accounts(spark, d).join(part, "account_id").select("account_id", name.alias("name"), country.alias("country"), risk.alias("kyc_risk"))


GIVEN, FAMILY = ("small", "red", "blue", "anna", "bruno"), ("ring", "bolt", "widget", "keller", "moreau")
# fixed values: typologies as pattern lists write them
TYPOLOGIES = ("FAN-OUT", "FAN-IN", "CYCLE", "SCATTER-GATHER", "BIPARTITE", "STACK", "GATHER-SCATTER", "RANDOM")


def pools(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """What the evaluation set draws from, by arithmetic on customer keys."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("account_id"))
    k = F.col("k")
    pick = lambda n, *vs: F.element_at(F.array(*vs), F.pmod(n, F.lit(len(vs))).cast("int") + 1)
    sev = pick(k, F.lit(None).cast("int"), F.lit(1), F.lit(2), F.lit(3), F.lit(2))
    rule = pick(k, F.lit(None).cast("string"), F.lit("CORRIDOR_001"), F.lit("FAN_OUT_001"), F.lit("STRUCT_001"), F.lit("FAN_IN_001"))
    match = k % 6 == 0
    least = F.when(match & (k % 12 == 0), 0.90).when(match, 0.85).otherwise(0.80)
    names = [F.lit(t) for t in TYPOLOGIES]
    return {
        "state": c.select("account_id", sev.alias("max_sev"), rule.alias("top_rule"), (k % 10 == 0).alias("is_flagged"), (k * 37 % 1000 / 1000.0).alias("percentile")),
        "truth": c.where(k % 3 == 0).select(k.alias("row_id"), "account_id", pick(k, F.lit("exact"), F.lit("typo_ocr"), F.lit("partial_reorder")).alias("match_flavor"), least.alias("expected_score_min"), F.when(match, 1.0).otherwise(0.88).alias("expected_score_max"), match.alias("gold_is_match")),
        "senders": c.where(k % 4 != 1).select("account_id"),
        "patterns": c.select(pick(k, *names).alias("typology"), "account_id").unionByName(c.where(k % 7 == 0).select(pick(k + 3, *names).alias("typology"), "account_id")),
    }
