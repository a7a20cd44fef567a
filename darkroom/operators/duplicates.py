"""Duplicate detection within albums: blocking, relations, complete-link groups, ranking and decisions.

Columns: album_id, photo_id, sha, phash (hexadecimal), histogram, aspect, taken_at, device, and for ranking quality, width,
height, uploaded_at, hard_reject, faces (a struct of counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import times, vectors
from darkroom.operators import graphs
from darkroom.sources.lineage import written

NEAR = {"hamming": 6, "aspect": 0.02, "histogram": 0.20}
BURST = {"hamming": 12, "aspect": 0.05, "histogram": 0.30, "ms": 3000}
BAND_BITS, NEIGHBOURS, MOST_MEMBERS = 5, 8, 64


def exact_groups(photos: DataFrame, *order: F.Column) -> DataFrame:
    """Photos whose content repeats in their album, ranked within the content: rank 1 is kept, the others are removed."""
    same = Window.partitionBy("album_id", "sha")
    ranked = photos.where(F.col("sha").isNotNull()).withColumn("copies", F.count("*").over(same)).withColumn("rank", F.row_number().over(same.orderBy(*(order or (F.asc("photo_id"),)))))
    return ranked.where("copies > 1").withColumn("decision", F.when(F.col("rank") == 1, "keep").otherwise("remove"))


def candidates(photos: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(album_id, a, b): distinct pairs of photos that are neighbours, in order of their hashes, in one of 13 bands of five bits.

    Linear in the photos: a photo meets at most `neighbours` others after it in each band. Photos of equal content are
    no pair here. The order within a band is by hash, then photo_id."""
    padded = F.lpad("phash", 16, "0")
    bits = F.lpad(F.concat(F.lpad(F.conv(F.substring(padded, 1, 8), 16, 2), 32, "0"), F.lpad(F.conv(F.substring(padded, 9, 8), 16, 2), 32, "0")), 64, "0")
    starts = F.array(*(F.struct(F.lit(o).alias("band"), F.lit(max(0, 64 - o - BAND_BITS) + 1).alias("at"), F.lit(min(BAND_BITS, 64 - o)).alias("width")) for o in range(0, 64, BAND_BITS)))
    rows = photos.where(F.length("phash") > 0).select("album_id", "photo_id", "sha", padded.alias("hash"), bits.alias("bits"), F.explode(starts).alias("s"))
    rows = rows.select("album_id", "photo_id", "sha", "hash", F.col("s.band").alias("band"), F.expr("substring(bits, s.at, s.width)").alias("value"))
    order = Window.partitionBy("album_id", "band", "value").orderBy("hash", "photo_id").rowsBetween(1, neighbours)
    others = F.collect_list(F.struct(F.col("photo_id").alias("id"), F.col("sha").alias("sha"))).over(order)
    paired = rows.withColumn("others", others).select("album_id", "photo_id", "sha", F.explode("others").alias("other"))
    different = paired.where(~F.coalesce(F.col("sha") == F.col("other.sha"), F.lit(False)))
    return different.select("album_id", F.least("photo_id", "other.id").alias("a"), F.greatest("photo_id", "other.id").alias("b")).distinct()


def relations(pairs: DataFrame, photos: DataFrame, near: dict = NEAR, burst: dict = BURST) -> DataFrame:
    """pairs with relation (exact, near, burst; null if none), hamming, histogram_distance, aspect_delta and delta_ms."""
    fields = ("sha", "phash", "histogram", "aspect", "taken_at", "device")
    side = lambda x: photos.select("album_id", F.col("photo_id").alias(x), F.struct(*fields).alias(f"_{x}"))
    p, q = F.col("_a"), F.col("_b")
    rows = pairs.join(side("a"), ["album_id", "a"]).join(side("b"), ["album_id", "b"])
    rows = rows.withColumns({
        "hamming": vectors.hamming(p["phash"], q["phash"]),
        "histogram_distance": vectors.histogram_distance(p["histogram"], q["histogram"]),
        "aspect_delta": F.when((p["aspect"] > 0) & (q["aspect"] > 0), F.abs(p["aspect"] - q["aspect"]) / F.greatest(p["aspect"], q["aspect"])).otherwise(1.0),
        "delta_ms": times.delta_ms(p["taken_at"], q["taken_at"]),
    })
    within = lambda t: (F.col("hamming") <= t["hamming"]) & (F.col("aspect_delta") <= t["aspect"]) & (F.col("histogram_distance") <= t["histogram"])
    same_device = F.coalesce(p["device"] == q["device"], F.lit(True))
    kind = F.when(F.col("_a.sha") == F.col("_b.sha"), "exact").when(within(near), "near").when((F.col("delta_ms") <= burst["ms"]) & same_device & within(burst), "burst")
    return rows.withColumn("relation", kind).drop("_a", "_b")


def complete_link(photos: DataFrame, related: DataFrame, most: int = MOST_MEMBERS, block: int = graphs.BLOCK) -> DataFrame:
    """(album_id, photo_id, group_id): groups of two or more in which all pairs across merged parts are related.

    Photos of equal content start as one, and are one node with their number as its weight; related pairs are taken by kind, then distance, then ids, and two
    groups merge if every pair across them is related and they stay within `most` members (see graphs.complete_groups, which deals
    albums of more than `block` related pairs over tasks). group_id is the smallest member. Photos without an album are in no group."""
    by = ["album_id"]
    same = photos.where(F.col("sha").isNotNull() & F.col("album_id").isNotNull()).groupBy("album_id", "sha").agg(F.min("photo_id").alias("node"), F.count("*").alias("weight")).where("weight > 1")
    copies = written(photos.select("album_id", "photo_id", "sha").join(same, ["album_id", "sha"]).select("album_id", "photo_id", "node", "weight"), "copies")
    kind = F.when(F.col("relation") == "exact", 0).when(F.col("relation") == "near", 1).otherwise(2)
    rank = F.struct(kind.alias("kind"), F.col("hamming").alias("distance"), "a", "b").alias("rank")
    edges = related.where(F.col("relation").isNotNull() & F.col("album_id").isNotNull()).select("album_id", "a", "b", rank).dropDuplicates(["album_id", "a", "b"])
    name = lambda x: copies.select("album_id", F.col("photo_id").alias(x), F.col("node").alias(f"n{x}"))
    named = edges.join(name("a"), ["album_id", "a"], "left").join(name("b"), ["album_id", "b"], "left").select("album_id", F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"), "rank").where("x <> y")
    links = written(named.groupBy("album_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), F.min("rank").alias("rank")), "links")
    ends = links.select("album_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = ends.join(copies.select("album_id", "node", "weight").distinct(), ["album_id", "node"], "left").select("album_id", "node", F.coalesce("weight", F.lit(1)).alias("weight"))
    groups = graphs.complete_groups(nodes, links, by, most, block)
    # copies are in their node's group; nodes of one photo stand for themselves
    of_copies = copies.join(groups, ["album_id", "node"], "left").select("album_id", "photo_id", F.coalesce("cluster", "node").alias("group_id"))
    of_nodes = groups.join(copies.select("album_id", F.col("photo_id").alias("node")), ["album_id", "node"], "left_anti").select("album_id", F.col("node").alias("photo_id"), F.col("cluster").alias("group_id"))
    return of_copies.unionByName(of_nodes)


def preferred_order() -> list[F.Column]:
    """The best first: not rejected, more and clearer faces, fewer faults, better, larger, earlier, smaller id."""
    face = lambda name: F.coalesce(F.col(f"faces.{name}"), F.lit(0))
    pixels = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0)).cast("long")
    return [
        F.coalesce("hard_reject", F.lit(False)).asc(), face("detected").desc(), face("clarity_p20").desc(), face("closed_eye").asc(), face("occlusion").asc(), face("edge_crop").asc(),
        face("expression").asc(), F.coalesce("quality", F.lit(0.0)).desc(), pixels.desc(), F.col("uploaded_at").asc_nulls_last(), F.col("photo_id").asc(),
    ]


def ranked(members: DataFrame) -> DataFrame:
    """members(album_id, group_id, ...) with rank, exact_rank (within equal content) and preferred."""
    group = Window.partitionBy("album_id", "group_id")
    order = preferred_order()
    content = Window.partitionBy("album_id", "group_id", "sha").orderBy("rank")
    return members.withColumn("rank", F.row_number().over(group.orderBy(*order))).withColumn("exact_rank", F.when(F.col("sha").isNotNull(), F.row_number().over(content)).otherwise(1)).withColumn("preferred", F.first("photo_id").over(group.orderBy("rank")))


def decided(ranked_members: DataFrame, exclude_exact: bool = True, exclude_rejected: bool = False) -> DataFrame:
    """Suggestion, confidence, auto_excluded and source of each member. Needs relation, hamming and histogram_distance to the preferred one (null: none)."""
    reject, copy, first = F.coalesce("hard_reject", F.lit(False)), F.col("exact_rank") > 1, F.col("rank") == 1
    # a histogram distance of exactly 0 counts as 1
    close = (F.col("relation") == "near") & (F.col("hamming") <= 4) & (F.coalesce(F.nullif(F.col("histogram_distance"), F.lit(0.0)), F.lit(1.0)) <= 0.10)
    close = F.coalesce(close, F.lit(False))
    had = F.coalesce("confidence", F.lit(0.0))
    return ranked_members.withColumns({
        "suggestion": F.when(reject, "remove" if exclude_rejected else "review").when(first, "keep").when(copy | close, "remove").otherwise("review"),
        "confidence": F.when(reject, F.greatest(had, F.lit(0.99))).when(first, F.greatest(had, F.lit(0.95))).when(copy, 1.0).when(close, 0.9).otherwise(F.greatest(had, F.lit(0.75))),
        "exclusion": F.when(reject & F.lit(exclude_rejected), "system_unrecoverable_blur").when(~first & copy & F.lit(exclude_exact), "system_exact_duplicate"),
    })


def group_summary(members: DataFrame) -> DataFrame:
    """(album_id, group_id, group_type, confidence, members): type mixed unless all relations are of one kind; confidence by distance within the kind's threshold."""
    # in whole parts of 1 / unit, so that neither the order of summation nor the rounding of parts decides
    unit = NEAR["hamming"] * BURST["hamming"]
    limit = F.when(F.col("relation") == "near", NEAR["hamming"]).otherwise(BURST["hamming"])
    sure = (F.col("rank") == 1) | (F.col("exact_rank") > 1) | F.col("relation").isNull() | (F.col("relation") == "exact")
    trust = F.when(sure, unit).otherwise(F.greatest(F.lit(0), unit - F.coalesce("hamming", F.lit(0)) * (F.lit(unit) / limit).cast("int"))).cast("long")
    kinds = F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(F.when(F.col("exact_rank") > 1, "exact"), F.when(F.col("rank") > 1, F.col("relation")))))))
    summed = members.groupBy("album_id", "group_id").agg(kinds.alias("kinds"), (F.sum(trust) * 10000).alias("total"), (F.count("*") * unit).alias("whole"), F.count("*").alias("members"))
    # a tie at the fourth place goes to the even one
    up = F.expr("2 * (total % whole) > whole OR 2 * (total % whole) = whole AND total div whole % 2 = 1").cast("int")
    kind = F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed")
    return summed.select("album_id", "group_id", ((F.expr("total div whole") + up) / 10000).alias("confidence"), "members", kind.alias("group_type"))
