"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import bpe, decontaminate, minhash, quality_rules, secret_scan
from darkroom.llm.catalogue import word_bpe_path
from darkroom.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list accept."""
    rules = quality_rules.learn_from(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return quality_rules.judge(rows, "doc.text", rules).where("judged.kept").select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs, "doc_id", "text")


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds."""
    return secret_scan.redact(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    rows = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), "text", word_bpe_path())
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_clean_of_benchmarks),
    ("secret_scan", without_secrets),
    ("bpe", as_tokens),
]

#: Learned rules, near-duplicate groups, tiles and merges are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
