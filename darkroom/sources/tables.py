"""Tables partitioned by album: replacement of whole albums, and a feature cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.operators.control import latest

CACHE_KEYS = ["photo_id", "sha", "provider", "model", "dimension", "feature_version"]


def replace_albums(rows: DataFrame, path: str, by: str = "album_id") -> None:
    """Writes rows in place of what the table holds of the same albums; other albums stay."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(photo_id, sha, ...) with the cached embedding of equal keys, null where it is to be computed. Of repeated keys the last update counts."""
    once = latest(cache, CACHE_KEYS, F.desc("updated_at"), F.desc("id")).select(*CACHE_KEYS, "embedding")
    return wanted.join(once, CACHE_KEYS, "left")


def copied(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of a listing (path, key) that a store (key) does not hold, one path for each key: what a migration copies."""
    return listing.join(stored.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("path").alias("path"))


def write_bundles(books: DataFrame, path: str) -> None:
    """Writes books(album_id, revision, kind, html) as one text file each, below album, revision and kind: kinds are preview, print and manifest.

    The html of a book goes out as it is; a revision that is there already is replaced, others stay."""
    rows = books.select("album_id", F.concat(F.lit("r"), F.col("revision").cast("string")).alias("revision"), "kind", "html")
    rows.repartition("album_id", "revision", "kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("album_id", "revision", "kind").text(path)
