"""Other files: pattern lists, sanctions XML, typed JSON lines and CSV, and the manifest of frozen files."""

from __future__ import annotations

import hashlib
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .publish import table_digest, write_json, write_parquet

__all__ = ["write_json", "write_parquet"]

GROUND_TRUTH = "row_id int, account_id string, assigned_name string, ofac_uid string, ofac_canonical_name string, match_flavor string, expected_score_min double, expected_score_max double, gold_is_match string"
EVAL = "case_id string, account_id string, gold_label string, case_type string, typology string, severity_band int, conflict_type string, relevant_txn_ids array<string>, notes string"
LATIN = "215"


class Manifest:
    """Write-once SHA-256 list of files and Parquet tables, by path relative to root; a table's path ends with a slash."""

    def __init__(self, path: Path, root: Path):
        self.path, self.root = path, root

    def entries(self) -> dict[str, str]:
        """Digests by key; an absolute path of an older line counts as its relative one."""
        lines = self.path.read_text().split("\n") if self.path.exists() else []
        held = {k: h for h, _, k in (x.partition("  ") for x in lines) if k}
        return {self._key(Path(k)) if Path(k).is_absolute() else k: h for k, h in held.items()}

    def _key(self, file: Path) -> str:
        return f"{file.resolve().relative_to(self.root.resolve())}{'/' * file.is_dir()}"

    def _digest(self, key: str, spark: SparkSession | None) -> str:
        """Of a file, read in chunks, or of a table's rows, hashed where they are (publish.table_digest)."""
        if key.endswith("/"):
            if spark is None:
                raise ValueError(f"{key} is a table: a session is needed")
            return table_digest(spark.read.parquet(str(self.root.resolve() / key)))
        with (self.root / key).open("rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def freeze(self, file: Path, force: bool = False, spark: SparkSession | None = None) -> None:
        held, key = self.entries(), self._key(file)
        if key in held and not force:
            raise ValueError(f"{key} is frozen")
        held[key] = self._digest(key, spark)
        part = self.path.with_name(f"{self.path.name}.tmp")
        part.write_text("".join(f"{h}  {k}\n" for k, h in held.items()))
        part.replace(self.path)

    def verify(self, spark: SparkSession | None = None) -> None:
        for key, h in self.entries().items():
            if not (self.root / key).exists() or self._digest(key, spark) != h:
                raise ValueError(f"{key} is missing or has changed")


def line_patterns(spark: SparkSession, path: str) -> DataFrame:
    """typology, account_ids: one typology a line (blank- or comma-separated), # comments and short lines skipped, repeats extended.

    The file is read whole, as a pattern list is small, so its accounts stay in file order. Short lines are warned of.
    """
    line = F.posexplode(F.split("value", r"\r?\n|\r")).alias("nr", "line")
    rows = spark.read.text(path, wholetext=True).select(line).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = rows.where("line <> '' AND NOT startswith(line, '#')").withColumn("w", F.filter(F.split("line", r"[\s,]+"), lambda w: w != ""))
    if short := [r.nr + 1 for r in rows.where("size(w) < 2").select("nr").limit(20).collect()]:
        warnings.warn(f"pattern lines without an account are skipped: {short}", stacklevel=2)
    each = rows.where("size(w) >= 2").select(F.element_at("w", 1).alias("typology"), F.struct("nr", F.slice("w", 2, 1 << 30).alias("ids")).alias("x"))
    held = each.groupBy("typology").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return held.select("typology", F.flatten(F.transform("xs", lambda x: x["ids"])).alias("account_ids"))


# fixed values: the marks of a block, in any letter case and spacing
_BEGIN, _END = r"(?i)^\s*BEGIN\s+LAUNDERING\s+ATTEMPT\s*-\s*([^:]*)", r"(?i)^\s*END\s+LAUNDERING\s+ATTEMPT"


def block_patterns(spark: SparkSession, path: str) -> DataFrame:
    """typology, account_id of complete BEGIN/END blocks; account ids are fields 2 and 4; a block that another begins in, or the file ends in, is dropped.

    Files are read line by line in as many splits as Spark makes of them. Inside a split, windows give each line the last mark before
    it and the next one after it; what reaches over splits comes from the first and last mark of each split, a row a split.
    """
    value = F.col("value")
    kind = F.when(value.rlike(_BEGIN), "B").when(value.rlike(_END), "E")
    at = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i")]
    mark = F.when(F.col("kind").isNotNull(), F.struct("kind", F.col("name").alias("typology")))
    lines = spark.read.text(path).select("value", kind.alias("kind"), F.trim(F.regexp_extract("value", _BEGIN, 1)).alias("name"), *at).withColumn("mark", mark)
    split = Window.partitionBy("f", "s").orderBy("i")
    rows = lines.where("kind is not null or size(split(value, ',')) > 4")
    rows = rows.withColumns({"last": F.last("mark", True).over(split.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("mark", True).over(split.rowsBetween(1, Window.unboundedFollowing))})
    ends = lines.groupBy("f", "s").agg(F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("i"))).alias("one"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("i"))).alias("two"))
    file = Window.partitionBy("f").orderBy("s")
    ends = ends.select("f", "s", F.last("two", True).over(file.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("one", True).over(file.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    rows = rows.where("kind is null").join(ends, ["f", "s"]).select("value", F.coalesce("last", "before").alias("last"), F.coalesce("next", "after").alias("next"))
    part = F.split("value", ",")
    ids = rows.where("last.kind = 'B' and next.kind = 'E'").select(F.col("last.typology").alias("typology"), F.explode(F.array(part[2], part[4])).alias("account_id"))
    return ids.select("typology", F.trim("account_id").alias("account_id")).where("account_id <> ''").distinct()


def pattern_labels(patterns: DataFrame) -> DataFrame:
    """account_id, label: the alphabetically first typology of each account."""
    return patterns.groupBy("account_id").agg(F.min("typology").alias("label"))


def sanctions_xml(spark: SparkSession, path: str, list_name: str = "SDN") -> DataFrame:
    """uid, canonical_name, aka_names, entry_type, list_name: Latin-script names of each party, the last primary one canonical."""
    value = "array<struct<_ScriptID:string,_VALUE:string>>"
    alias = f"array<struct<_Primary:string,DocumentedName:array<struct<DocumentedNamePart:array<struct<NamePartValue:{value}>>>>>>"
    schema = f"_FixedRef string, Profile struct<_PartySubTypeID:string,Identity:struct<Alias:{alias}>>"
    party = spark.read.format("xml").option("rowTag", "DistinctParty").schema(schema).load(path)
    types = spark.read.format("xml").option("rowTag", "PartySubType").schema("_ID string, _PartyTypeID string").load(path)
    values = lambda a: F.flatten(F.flatten(F.transform(a["DocumentedName"], lambda n: F.transform(n["DocumentedNamePart"], lambda p: p["NamePartValue"]))))
    latin = lambda a: F.array_join(F.transform(F.filter(values(a), lambda v: v["_ScriptID"] == LATIN), lambda v: F.trim(v["_VALUE"])), " ")
    named = F.transform("Profile.Identity.Alias", lambda a: F.struct((F.lower(a["_Primary"]) == "true").alias("primary"), latin(a).alias("name")))
    rows = party.select(F.col("_FixedRef").alias("uid"), F.col("Profile._PartySubTypeID").alias("sub"), F.filter(named, lambda n: n["name"] != "").alias("names"))
    canonical = F.element_at(F.filter("names", lambda n: n["primary"]), -1)["name"]
    rows = rows.select("uid", "sub", F.when(F.exists("names", lambda n: n["primary"]), canonical).alias("canonical_name"), F.transform(F.filter("names", lambda n: ~F.coalesce(n["primary"], F.lit(False))), lambda n: n["name"]).alias("aka_names"))
    kind = F.when(F.col("_PartyTypeID") == "1", "Individual").otherwise("Entity")
    rows = rows.where("uid is not null and canonical_name is not null").join(types, rows["sub"] == types["_ID"], "left")
    return rows.select("uid", "canonical_name", "aka_names", kind.alias("entry_type"), F.lit(list_name).alias("list_name"))


def load_records(spark: SparkSession, first: str, second: str | None = None) -> DataFrame:
    """Records of the main list and, if it is there, of the consolidated one."""
    out = sanctions_xml(spark, first, "SDN")
    return out.unionByName(sanctions_xml(spark, second, "Consolidated")) if second is not None and _exists(spark, second) else out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_names(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.concat(F.array("canonical_name"), "aka_names")).alias("name")).distinct()


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that hold more than blanks."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def write_json_file(rows: DataFrame, file: Path, by: str, most: int = 100_000) -> None:
    """One JSON-lines file on the driver, in order of a column, by a temporary file and a rename: for frozen artifacts of counted size."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows; a single file takes {most} at most")
    lines = [r[0] for r in rows.orderBy(by).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_suffix(".tmp")
    part.write_text("".join(f"{x}\n" for x in lines))
    part.replace(file)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a line that doesn't fit stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema=GROUND_TRUTH, header=True)
    return raw.withColumn("gold_is_match", F.lower("gold_is_match") == "true")


def write_ground_truth(rows: DataFrame, file: Path, manifest: Manifest | None = None, positive: int = 20, negative: int = 30) -> None:
    """One CSV file of exactly so many rows, in order of row_id, which the manifest then freezes."""
    n = rows.agg(F.count_if("gold_is_match").alias("p"), F.count_if(~F.col("gold_is_match")).alias("n")).first()
    if (n["p"], n["n"]) != (positive, negative):
        raise ValueError(f"{n['p']} positive and {n['n']} negative rows; {positive} and {negative} are wanted")
    held = rows.select(*[c.split(" ")[0] for c in GROUND_TRUTH.split(", ")]).orderBy("row_id").toPandas()  # as many as were just counted
    held["gold_is_match"] = held["gold_is_match"].map({True: "True", False: "False"})
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_suffix(".tmp")
    held.to_csv(part, index=False)
    part.replace(file)
    if manifest is not None:
        manifest.freeze(file)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of small files, each held whole by a task (2 GB at most); for tables of any size there is publish.table_digest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
