"""Corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktriage.llm.common import release, table, table_mark, written
from sparktriage.llm.decontaminate import drop_contaminated
from sparktriage.llm.pieces import encode_documents
from sparktriage.llm.quality import score_quality, train_quality
from sparktriage.llm.similar import keep_dissimilar
from sparktriage.llm.suffix_dedup import remove_repeats

ORACLE_SQL = None  # trained scores, shingle sets and pieces are beyond SQL; tests/llm holds every stage against a plain version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows outside its held-out fold, doesn't reject.

    Null text is scored as empty text; without any usable label all are kept; repeated rows are kept or go together.
    """
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), prefix="__quality_")
    return scored.where("__quality_predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of Jaccard similarity 0.8 or more: the one with the smallest id.

    Candidates come from SimHash fingerprints, and beyond their radius from prefixes; whole sets of shingles decide.
    Texts without words (null, empty, blanks) are one group; null ids come after all others; of equal rows one stays.
    """
    return keep_dissimilar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of 200 bytes that occur elsewhere too; n_chars follows the text.

    Null text stays null and keeps its n_chars; a character is taken out only as a whole.
    """
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; those without words always stay, an empty benchmark drops none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the piece ids of each whole text; null or empty text has none."""
    out = encode_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage is written, the tables of those before it go."""
    docs, mark = table(spark, sf_dir, "documents"), table_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, table_mark() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
