"""The chains of operators from end to end: cleaning, theme selection and chapters, books."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions import decisions
from darkroom.operators import duplicates, layout, representatives, review, theme, timeline


class Cleaned(NamedTuple):
    members: DataFrame
    groups: DataFrame
    photos: DataFrame
    summary: DataFrame
    queue: DataFrame


def clean(photos: DataFrame, near: dict = duplicates.NEAR, burst: dict = duplicates.BURST, exclude_exact: bool = True, exclude_rejected: bool = False) -> Cleaned:
    """Analysed photos to groups of duplicates, decisions, a summary by album and the queue of what users are asked."""
    related = duplicates.relations(duplicates.candidates(photos), photos, near, burst)
    members = duplicates.ranked(duplicates.complete_link(photos, related).join(photos, ["album_id", "photo_id"]))
    # the relation of each member to the one preferred, whether or not the pair was a candidate
    to_best = members.where("photo_id <> preferred").select("album_id", F.least("photo_id", "preferred").alias("a"), F.greatest("photo_id", "preferred").alias("b"), F.col("photo_id").alias("of"))
    known = duplicates.relations(to_best, photos, near, burst).select("album_id", F.col("of").alias("photo_id"), "relation", "hamming", "histogram_distance", "aspect_delta", "delta_ms")
    decided = duplicates.decided(members.join(known, ["album_id", "photo_id"], "left"), exclude_exact, exclude_rejected)
    groups = duplicates.group_summary(decided).join(decided.where("rank = 1").select("album_id", "group_id", "preferred"), ["album_id", "group_id"])
    outcome = decided.select("album_id", "photo_id", F.col("suggestion").alias("_s"), F.col("confidence").alias("_c"), F.col("exclusion").alias("_x"))
    reject = F.coalesce("hard_reject", F.lit(False))
    final = photos.join(outcome, ["album_id", "photo_id"], "left").withColumns({
        "suggestion": F.coalesce("_s", F.when(reject, "remove" if exclude_rejected else "review"), F.col("suggestion")), "confidence": F.coalesce("_c", F.when(reject, F.greatest("confidence", F.lit(0.99))), F.col("confidence")),
        "exclusion": F.coalesce("_x", F.when(reject & F.lit(exclude_rejected), "system_unrecoverable_blur")),
    }).drop("_s", "_c", "_x")
    final = final.withColumn("decision", F.coalesce("decision", F.when(F.col("exclusion").isNotNull(), "remove")))
    return Cleaned(decided, groups, final, review.summary(final), review.queue(final, groups, decided.select("album_id", "group_id", "photo_id", "rank")))


def chapters(photos: DataFrame, query: DataFrame | None = None, threshold: float = 0.60, **how) -> DataFrame:
    """Included photos, of a theme where a query is given, with their chapters: by sequence where an album has an embedding, else by events."""
    rows = photos.where(decisions.included(F.col("decision")))
    if query is not None:
        rows = theme.relevance(rows, query, threshold).where("decision = 'keep'").withColumn("decision", F.lit(None).cast("string"))
    has = rows.groupBy("album_id").agg(F.count("embedding").alias("n"))
    by_sequence = timeline.sequential(rows.join(has.where("n > 0"), "album_id", "left_semi"), **how).select("album_id", "photo_id", "chapter")
    plain = rows.join(has.where("n = 0"), "album_id", "left_semi")
    events = timeline.event_boundaries(plain)
    timed = events.select("album_id", "photo_id", F.col("event").cast("int").alias("chapter"))
    late = timeline.assign_untimed(plain.where("taken_at IS NULL"), events).select("album_id", "photo_id", F.col("event").cast("int").alias("chapter"))
    return rows.join(by_sequence.unionByName(timed).unionByName(late), ["album_id", "photo_id"])


def books(chaptered: DataFrame, titles: DataFrame, caption: str, per_page: int = 3) -> DataFrame:
    """(album_id, html) of chaptered photos; those without a chapter come last."""
    placed = layout.pages(chaptered.withColumn("chapter", F.coalesce("chapter", F.lit(1 << 30))).withColumn("place", F.struct(F.col("taken_at").isNull(), "taken_at")), per_page)
    return layout.books(layout.markup(placed, layout.templates(placed), caption), titles)


def covers(chaptered: DataFrame) -> DataFrame:
    """Up to three representatives of each chapter."""
    return representatives.representatives(chaptered, "album_id", "chapter")
