"""Review queues, summaries, and the application of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions import decisions

# fixed values: reasons that come from faces
FACE_REASONS = ("face_analysis_failed", "face_edge_crop_suspected", "face_blur_suspected", "closed_eyes_suspected", "face_occlusion_suspected", "body_crop_suspected", "expression_attention")


def priority(reasons: F.Column, duplicate: F.Column) -> F.Column:
    return (
        F.when(F.array_contains(reasons, "analysis_failed"), 100).when(F.arrays_overlap(reasons, F.array(*map(F.lit, FACE_REASONS))), 80)
        .when(duplicate, 70).when(F.array_contains(reasons, "sharpness_severe"), 65).otherwise(50)
    )


def queue(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One item for each group with a photo to review, and one for each other photo to review.

    photos(album_id, photo_id, decision, suggestion, issues), groups(album_id, group_id, group_type, confidence, preferred),
    members(album_id, group_id, photo_id, rank). Each photo is asked for once. Order by priority descending, kind and item."""
    asked = photos.withColumn("pending", decisions.pending(F.col("decision"), F.col("suggestion")))
    joined = members.join(asked, ["album_id", "photo_id"])
    by_group = joined.groupBy("album_id", "group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "photo_id"))), lambda m: m["photo_id"]).alias("photo_ids"),
        F.flatten(F.collect_list(F.coalesce("issues", F.array().cast("array<string>")))).alias("issues"), F.count_if("pending").alias("pending"),
    )
    grouped = by_group.where("pending > 0").join(groups, ["album_id", "group_id"])
    reasons = F.array_sort(F.array_distinct(F.concat(F.array(F.concat(F.lit("duplicate_"), F.col("group_type"))), F.col("issues"))))
    first = grouped.select(
        "album_id", F.concat(F.lit("group:"), F.col("group_id").cast("string")).alias("item"), F.lit("duplicate_group").alias("kind"), "photo_ids", reasons.alias("reasons"),
        F.when(F.coalesce("confidence", F.lit(0.0)) >= 0.8, "accept_preferred").otherwise("keep_all").alias("action"),
    )
    taken = first.select("album_id", F.explode("photo_ids").alias("photo_id"))
    alone = asked.where("pending").join(taken, ["album_id", "photo_id"], "left_anti")
    second = alone.select(
        "album_id", F.concat(F.lit("photo:"), F.col("photo_id").cast("string")).alias("item"), F.lit("single_photo").alias("kind"), F.array("photo_id").alias("photo_ids"),
        F.array_sort(F.array_distinct(F.coalesce("issues", F.array().cast("array<string>")))).alias("reasons"), F.when(F.col("suggestion") == "remove", "remove").otherwise("keep").alias("action"),
    )
    return first.unionByName(second).withColumn("priority", priority(F.col("reasons"), F.col("kind") == "duplicate_group"))


def summary(photos: DataFrame) -> DataFrame:
    """Counts of each album's photos by suggestion, decision and status."""
    status = decisions.review_status(F.col("decision"), F.col("suggestion"))
    n = F.count_if
    return photos.groupBy("album_id").agg(
        F.count("*").alias("total"), n(F.col("suggestion") == "keep").alias("suggested_keep"), n(F.col("suggestion") == "review").alias("suggested_review"), n(F.col("suggestion") == "remove").alias("suggested_remove"),
        n(status == "pending_review").alias("pending"), n(status == "kept").alias("kept"), n(status == "removed").alias("removed"), n(status == "unanalyzed").alias("unanalyzed"), n(decisions.included(F.col("decision"))).alias("included"),
    )


def changes(current: DataFrame, wanted: DataFrame, keep_user: bool = False) -> DataFrame:
    """(album_id, photo_id, before, after, source_before, source_after): decisions that differ from what is stored, the rows of an audit log.

    current and wanted have album_id, photo_id, decision and source. keep_user: what users decided stays, as in a new automatic run."""
    both = wanted.select("album_id", "photo_id", F.col("decision").alias("after"), F.col("source").alias("source_after")).join(current.select("album_id", "photo_id", F.col("decision").alias("before"), F.col("source").alias("source_before")), ["album_id", "photo_id"])
    moved = both.where(~F.col("before").eqNullSafe(F.col("after")) | ~F.col("source_before").eqNullSafe(F.col("source_after")))
    return moved.where(~F.coalesce(F.col("source_before").isin("user", "user_delegated"), F.lit(False))) if keep_user else moved


def accept_preferred(groups: DataFrame, members: DataFrame, least: float = 0.8) -> DataFrame:
    """Wanted decisions for groups of enough confidence: the preferred photo is kept, the others go."""
    sure = groups.where(F.col("confidence") >= least).select("album_id", "group_id", "preferred")
    return members.join(sure, ["album_id", "group_id"]).select("album_id", "photo_id", F.when(F.col("photo_id") == F.col("preferred"), "keep").otherwise("remove").alias("decision"), F.lit("user_delegated").alias("source"))


def resolved(photos: DataFrame, groups: DataFrame, members: DataFrame, requests: DataFrame) -> DataFrame:
    """(album_id, photo_id, decision, source) that requests for single items of a queue ask for. requests(album_id, item, action).

    Of a photo: keep or remove. Of a group: keep_all, or accept_preferred, which removes all but the preferred. Other actions, and items that
    don't exist, ask for nothing."""
    kind, id = F.split("item", ":", 2)[0], F.split("item", ":", 2)[1]
    asked = requests.select("album_id", "action", kind.alias("kind"), id.alias("id"))
    photo = asked.where("kind = 'photo' AND action IN ('keep', 'remove')").join(photos.select("album_id", "photo_id", F.col("photo_id").cast("string").alias("id")), ["album_id", "id"])
    one = photo.select("album_id", "photo_id", F.col("action").alias("decision"))
    group = asked.where("kind = 'group' AND action IN ('accept_preferred', 'keep_all')").join(groups.select("album_id", "group_id", "preferred", F.col("group_id").cast("string").alias("id")), ["album_id", "id"])
    gone = (F.col("action") == "accept_preferred") & ~F.col("photo_id").eqNullSafe(F.col("preferred"))
    many = group.join(members.select("album_id", "group_id", "photo_id"), ["album_id", "group_id"]).select("album_id", "photo_id", F.when(gone, "remove").otherwise("keep").alias("decision"))
    return one.unionByName(many).withColumn("source", F.lit("user"))


def resolved_remaining(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(album_id, photo_id, decision, source) that settle a whole queue by each item's own action, for photos without a decision."""
    items = queue(photos, groups, members).select("album_id", "item", "kind", "action", F.explode("photo_ids").alias("photo_id"))
    best = groups.select("album_id", F.concat(F.lit("group:"), F.col("group_id").cast("string")).alias("item"), "preferred")
    open_ = photos.where(F.col("decision").isNull()).select("album_id", "photo_id")
    rows = items.join(best, ["album_id", "item"], "left").join(open_, ["album_id", "photo_id"], "left_semi")
    gone = (F.col("action") == "remove") | ((F.col("action") == "accept_preferred") & ~F.col("photo_id").eqNullSafe(F.col("preferred")))
    return rows.select("album_id", "photo_id", F.when(gone, "remove").otherwise("keep").alias("decision"), F.lit("user_delegated").alias("source"))


def reset(photos: DataFrame, analysis: list[str], clear_users: bool = False) -> DataFrame:
    """photos without what an analysis found, and without decisions but users' (these too with clear_users)."""
    stays = F.lit(not clear_users) & F.coalesce(F.col("source").isin("user", "user_delegated"), F.lit(False))
    kinds = dict(photos.dtypes)
    return photos.withColumns({c: F.lit(None).cast(kinds[c]) for c in analysis} | {c: F.when(stays, F.col(c)) for c in ("decision", "source")})
