"""Albums of photos derived from the given tables, in DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int = 2000) -> DataFrame:
    """rows by key in parts of about `each`: for work on a row that is long beside its reading, as a file of few bytes is one task."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photos of their users' albums."""
    i = F.col("event_id")
    here = i % 7 != 0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("album_id"), i.alias("photo_id"), F.when(i % 11 != 0, F.col("ts")).alias("taken_at"), F.col("ts").alias("uploaded_at"), F.col("event_type").alias("device"),
        F.when(here, (i * 37 % 1800).cast("double") / 10 - 90).alias("lat"), F.when(here, (i * 91 % 3600).cast("double") / 10 - 180).alias("lon"),
        F.array("event_type", F.concat(F.lit("k"), (i % 4).cast("string"))).alias("tags"), F.lit(None).cast("array<double>").alias("histogram"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("phash"),
        ((i * 53 % 1001).cast("double") / 100).alias("quality"), (800 + i * 17 % 2400).cast("int").alias("width"), (800 + i * 29 % 2400).cast("int").alias("height"),
        F.when(i % 5 == 0, "keep").when(i % 5 == 1, "remove").alias("decision"), F.when(i % 4 == 0, "review").when(i % 4 == 1, "remove").when(i % 4 == 2, "keep").alias("suggestion"),
        F.array_compact(F.array(F.when(i % 6 == 0, "sharpness_severe"), F.when(i % 10 == 0, "closed_eyes_suspected"), F.when(i % 50 == 0, "analysis_failed"))).alias("issues"),
    )


PHOTOS = """photos AS (
  SELECT user_id AS album_id, event_id AS photo_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS taken_at, ts AS uploaded_at, event_type AS device,
    CASE WHEN event_id % 7 <> 0 THEN (event_id * 37 % 1800)::DOUBLE / 10 - 90 END AS lat, CASE WHEN event_id % 7 <> 0 THEN (event_id * 91 % 3600)::DOUBLE / 10 - 180 END AS lon,
    [event_type, 'k' || (event_id % 4)] AS tags, (event_id * 53 % 1001)::DOUBLE / 100 AS quality, 800 + event_id * 17 % 2400 AS width, 800 + event_id * 29 % 2400 AS height,
    CASE event_id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' END AS decision, CASE event_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'remove' WHEN 2 THEN 'keep' END AS suggestion,
    list_filter([CASE WHEN event_id % 6 = 0 THEN 'sharpness_severe' END, CASE WHEN event_id % 10 = 0 THEN 'closed_eyes_suspected' END, CASE WHEN event_id % 50 = 0 THEN 'analysis_failed' END], lambda x: x IS NOT NULL) AS issues
  FROM events)"""

ALBUMS = 20


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as photos with embeddings, with a photo's time and place, in ALBUMS albums to 500 vectors and so many for each 500."""
    base = photos(spark, sf_dir).drop("album_id", "embedding", "histogram", "phash", "tags")
    v = vectors.doubles(F.col("embedding"))
    bits = vectors.sign_bits(v)
    half = lambda at: F.lpad(F.lower(F.conv(F.substring(bits, at, 32), 2, 16)), 8, "0")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("photo_id"), (F.col("vec_id") % ALBUMS + F.floor(F.col("vec_id") / 500) * ALBUMS).alias("album_id"), v.alias("embedding"), F.transform(F.slice(v, 1, 48), F.abs).alias("raw"),
        F.concat(half(1), half(33)).alias("phash"), F.col("label").alias("label"), F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("k"), (F.col("vec_id") % 3).cast("string"))).alias("tags"),
    )
    return rows.withColumn("histogram", vectors.shares(F.col("raw"))).drop("raw").join(base, "photo_id").withColumn("aspect", F.col("width") / F.col("height")).withColumn("sha", F.sha2(F.col("phash"), 256))


EMBEDDED = (
    PHOTOS
    + """, embedded AS (
  SELECT vec_id % 20 + vec_id // 500 * 20 AS album_id, vec_id AS photo_id, list_transform(e.embedding, lambda x: x::DOUBLE) AS embedding, list_transform(e.embedding[1:48], lambda x: abs(x::DOUBLE)) AS raw, label,
    array_to_string(list_transform(e.embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits, ['l' || label, 'k' || (vec_id % 3)] AS scene,
    p.taken_at, p.lat, p.lon, p.device, p.quality, p.width / p.height AS aspect
  FROM embeddings e JOIN photos p ON p.photo_id = e.vec_id), e AS (
  SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS histogram, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS unit FROM embedded)"""
)

KM = """CASE WHEN {a}.lat IS NOT NULL AND {b}.lat IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) END"""


def km(a: str, b: str) -> str:
    return KM.format(a=a, b=b)


def piecewise(x: str, points: list[tuple[float, float]]) -> str:
    parts = [f"WHEN {x} <= {points[0][0]} THEN {points[0][1]}"]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        parts.append(f"WHEN {x} <= {x1} THEN {y0} + ({y1 - y0!r}) * ({x} - {x0}) / {x1 - x0}")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {points[-1][1]} END"


def weighted(parts: list[tuple[str, float]], otherwise: str = "NULL") -> str:
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0.0 END" for c, w in parts)
    total = " + ".join(f"coalesce({c} * {w}, 0.0)" for c, w in parts)
    return f"CASE WHEN ({weight}) > 0 THEN ({total}) / ({weight}) ELSE {otherwise} END"


JACCARD = "(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"
