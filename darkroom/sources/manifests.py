"""Evaluation manifests with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANING = (
    "id string, album_id string, path string, taken_at string, device_model string, duplicate_cluster_id string, quality_label string, must_keep boolean, should_remove boolean, acceptable_preferred boolean, "
    "baseline_excluded boolean, blur_type string, blur_direction string, blur_strength double, texture_class string, recognizable_at_1024 boolean, recognizable_at_512 boolean, resize_family_id string"
)
RELEVANCE = (
    "album_id string, photo_id string, theme_id string, theme_category string, label string, positive_similarity double, raw_query_similarity double, expanded_query_similarity double, "
    "negative_similarity double, margin double, provider string, model string, dimension int, query_version string, scoring_version string, annotators array<string>"
)
CHAPTERS = "photo_id string, expected_chapter string, predicted_chapter string"


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object on each line."""
    return spark.read.schema(schema).json(path)


def items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of objects, or an object whose `items` is one. Of a list, Spark's reader makes a row for each object."""
    rows = spark.read.schema(f"items array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>, {schema}").option("multiLine", True).json(path)
    own = F.array(F.struct(*(F.col(f.name) for f in rows.schema.fields if f.name != "items")))
    return rows.select(F.explode(F.coalesce("items", own)).alias("item")).select("item.*")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state) of every file that a manifest names or that is there: ok, missing, unlisted, or mismatch where the SHA-256 differs.

    files(name, content), manifest(name, sha256); only digests move."""
    have = files.select("name", F.sha2("content", 256).alias("have"))
    both = manifest.select("name", F.lower("sha256").alias("want"), F.lit(True).alias("listed")).join(have, "name", "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("have").eqNullSafe(F.col("want")), "ok").otherwise("mismatch")
    return both.select("name", state.alias("state"))
