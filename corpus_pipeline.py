"""A training corpus from documents: toxic documents go, one of each group of near copies stays, documents with
benchmark passages go, personal data become pseudonyms, and sources are mixed to their target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.decontaminate import contamination, sided
from ledgerspark.llm.entries import PII_KEY
from ledgerspark.llm.jaccard import near_duplicates, text_key
from ledgerspark.llm.mixing import mix
from ledgerspark.llm.pii import pseudonymise
from ledgerspark.llm.shared import table, written
from ledgerspark.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of 0.7 or more."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; of rows that repeat an id and a text one. Unlike texts
    under one id are documents of their own. Rows without an id stay."""
    found = written(near_duplicates(docs, keyed=True), "stage-near").where("doc_id is not null")
    gone = found.where("not first").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    again = found.where("first").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).count().where("count > 1").select("_id", "_key")
    same = (F.col("doc_id") == F.col("_id")) & (text_key() == F.col("_key"))
    kept = docs.join(sided(gone), same, "left_anti")
    if again.head(1):
        again = sided(again)
        once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = written(contamination(docs, table(spark, sf_dir, "benchmark")), "stage-leaks")
    gone = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(sided(gone), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key")), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    new = pseudonymise(docs, PII_KEY).drop("pii_kinds")
    return new.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else new


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: taken / size copies of each."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The first stage is a fitted classifier; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
