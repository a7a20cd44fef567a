"""Representative photos of a group: a good typical one first, then good ones that differ."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import geo, scoring, texts, times, vectors
from darkroom.operators import distances

NEAR_COPY = 8


def _visual(a: Column, b: Column) -> Column:
    """From embeddings if both have one of equal length, else scenes and histograms."""
    e = F.when((F.size(a["embedding"]) > 0) & (F.size(a["embedding"]) == F.size(b["embedding"])), scoring.clamp((vectors.dot(vectors.doubles(a["embedding"]), vectors.doubles(b["embedding"])) - 0.2) / 0.75))
    rest = scoring.weighted([(texts.jaccard(texts.scene_tags(a["tags"]), texts.scene_tags(b["tags"])), 0.75), (vectors.histogram_overlap(a["histogram"], b["histogram"]), 0.25)])
    return F.coalesce(e, rest)


def _quality(p: Column) -> Column:
    return F.coalesce(scoring.clamp(p["quality"] / 10), F.lit(0.5))


def typicality(photos: DataFrame, *group: str) -> DataFrame:
    """group and photo_id with the mean visual similarity to the group's other photos, summed by blocks of photos; 0.5 without one."""
    mean = distances.mean_similarity(photos, *group)
    return photos.select(*group, "photo_id").join(mean, [*group, "photo_id"], "left").withColumn("typicality", F.coalesce("mean", F.lit(0.5))).drop("mean")


def first_picks(photos: DataFrame, *group: str) -> DataFrame:
    """The first representative of each group: .5 quality, .3 typicality, .2 completeness; the earliest of equals, without time last."""
    complete = (F.col("taken_at").isNotNull().cast("int") + geo.valid(F.col("lat"), F.col("lon")).cast("int") + (F.coalesce(F.size("tags"), F.lit(0)) > 0).cast("int")) / 3
    quality = F.coalesce(scoring.clamp(F.col("quality") / 10), F.lit(0.5))
    rows = photos.join(typicality(photos, *group), [*group, "photo_id"]).withColumn("score", 0.5 * quality + 0.3 * F.col("typicality") + 0.2 * complete)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("taken_at"), F.col("photo_id").cast("string")))).where("n = 1").drop("n")


def _gain(p: Column) -> tuple[Column, Column]:
    """Score of a photo beside those chosen, and whether it may be chosen. Needs the columns chosen, span and timed."""

    def over(f, fold) -> Column:
        return fold(F.filter(F.transform("chosen", lambda c: f(p, c)), lambda x: x.isNotNull()))

    novelty = F.coalesce(1 - over(lambda a, c: texts.jaccard(texts.scene_tags(a["tags"]), texts.scene_tags(c["tags"])), F.array_max), F.lit(0.5))
    differ = F.coalesce(1 - over(_visual, F.array_max), F.lit(0.5))
    near = over(lambda a, c: vectors.hamming(a["phash"], c["phash"]), F.array_min) <= NEAR_COPY
    gain_t = F.when(F.col("timed") > 1, scoring.clamp(over(lambda a, c: F.abs(times.micros(a["taken_at"]) - times.micros(c["taken_at"])) / 1e6, F.array_min) / F.col("span")))
    gain_d = scoring.clamp(over(lambda a, c: geo.haversine_km(a["lat"], a["lon"], c["lat"], c["lon"]), F.array_min) / 300)
    gain = scoring.weighted([(gain_t, 1.0), (gain_d, 1.0)], 0.5)
    score = 0.45 * _quality(p) + 0.25 * novelty + 0.15 * gain + 0.15 * differ
    return score, ~F.exists("chosen", lambda c: c["photo_id"] == p["photo_id"]) & ~F.coalesce(near, F.lit(False))


def representatives(photos: DataFrame, *group: str, limit: int = 3) -> DataFrame:
    """(group, nth, photo_id): up to `limit` representatives. After the first, photos near a selected one by hash are left out and the best of
    .45 quality, .25 scene novelty, .15 gain in time and place, .15 visual difference is taken; `limit` joins, no loop over rows."""
    fields = ("photo_id", "taken_at", "lat", "lon", "tags", "histogram", "embedding", "phash", "quality")
    rows = photos.select(*group, F.struct(*fields).alias("p"))
    span = photos.groupBy(*group).agg((F.greatest(F.lit(1.0), (times.micros(F.max("taken_at")) - times.micros(F.min("taken_at"))) / 1e6)).alias("span"), F.count("taken_at").alias("timed"))
    picked = first_picks(photos, *group).select(*group, F.array(F.struct(*fields)).alias("chosen"))
    for _ in range(limit - 1):
        both = rows.join(picked, list(group)).join(span, list(group))
        score, free = _gain(F.col("p"))
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("p.taken_at"), F.col("p.photo_id").cast("string"))
        best = both.where(free).withColumn("score", score).withColumn("n", F.row_number().over(order)).where("n = 1").select(*group, F.col("p").alias("more"))
        picked = picked.join(best, list(group), "left").select(*group, F.when(F.col("more").isNotNull(), F.concat("chosen", F.array("more"))).otherwise(F.col("chosen")).alias("chosen"))
    return picked.select(*group, F.posexplode("chosen").alias("nth", "c")).select(*group, (F.col("nth") + 1).alias("nth"), F.col("c.photo_id").alias("photo_id"))


__all__ = ["first_picks", "representatives", "typicality"]
