"""Relevance of photos to a theme, by similarity of vectors and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import scoring, structures, texts, times, vectors


def relevance(photos: DataFrame, query: DataFrame, threshold: float = 0.60, automatic: bool = True) -> DataFrame:
    """photos with similarities, score, label, decision and reasons.

    photos: embedding, provider, model, taken_at. query: one row with positive, expansions, negatives (unit vectors), provider,
    model, years, start, end; it is one row by construction, so it is broadcast. Without a query row every photo is for review.
    Gates in order: no query, no vector, another model or length, no valid vector, time, threshold."""
    q = query.limit(1).select(F.struct("*").alias("q"))
    rows = photos.join(F.broadcast(q), F.lit(True), "left")
    unit = vectors.normalized(vectors.doubles(F.col("embedding")))
    rows = rows.withColumn("unit", unit)
    cos = lambda v: vectors.cosine(F.col("unit"), v)
    rows = rows.withColumns({
        "raw": cos(F.col("q.positive")),
        "expanded": F.when(F.size("q.expansions") > 0, F.aggregate(F.transform("q.expansions", cos), F.lit(0.0), lambda a, x: a + x) / F.size("q.expansions")),
        "negative": F.array_max(F.transform("q.negatives", cos)),
    })
    rows = rows.withColumn("positive", scoring.positive_similarity(F.col("raw"), F.col("expanded")))
    rows = rows.withColumn("signal", scoring.signal(F.col("positive"), F.col("negative"))).withColumn("rank_score", scoring.clamp((F.col("signal") + 1) / 2))
    forced = times.constraint(F.col("taken_at"), F.col("q.years"), F.col("q.start"), F.col("q.end"))
    same = (F.col("provider") == F.col("q.provider")) & (F.col("model") == F.col("q.model")) & (F.size("embedding") == F.size("q.positive"))
    missing = (
        F.when(F.col("q").isNull(), "theme_query_unavailable").when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "photo_embedding_unavailable")
        .when(~F.coalesce(same, F.lit(False)), "embedding_model_mismatch").when(F.col("unit").isNull(), "invalid_embedding_vector")
    )
    keep = F.col("rank_score") >= threshold
    out = (F.col("forced") == "exclude_year") | (F.col("forced") == "exclude_dates")
    rows = rows.withColumn("forced", forced).withColumn("missing", missing)
    review = F.col("missing").isNotNull() | (F.col("forced") == "review") | F.lit(not automatic)
    decision = F.when(review, "review").when(out | ~keep, "exclude").otherwise("keep")
    score = F.when(F.col("missing").isNotNull(), 0.5).when(~review & out, 0.0).otherwise(F.col("rank_score"))
    why_time = F.when(F.col("forced") == "review", "missing_capture_time").when(F.col("forced") == "exclude_year", "outside_requested_year").when(F.col("forced") == "exclude_dates", "outside_requested_date_range").when(F.col("forced") == "match", "matched_time_constraint")
    settled = F.col("missing").isNull() & (F.col("forced") != "review")
    by_score = F.when(settled & ~out & F.lit(automatic), F.when(keep, "provisional_threshold_match").otherwise("provisional_threshold_mismatch")).when(settled & out & F.lit(not automatic), "constraint_mismatch_unconfirmed")
    kind = F.when(settled & (~out | F.lit(not automatic)), "provisional_threshold")
    return rows.withColumns({
        "decision": decision, "score": score, "label": F.when(decision == "keep", "relevant").when(decision == "exclude", "off_theme").otherwise("uncertain"),
        "reasons": F.array_compact(F.array(why_time, F.col("missing"), by_score, kind)),
    }).drop("q", "unit", "forced", "missing", "rank_score")


def summary(assessments: DataFrame, *keys: str) -> DataFrame:
    """Counts of assessments: user_decision over suggested_decision."""
    now = F.coalesce(F.nullif("user_decision", F.lit("")), F.col("suggested_decision"))
    n = F.count_if
    return assessments.groupBy(*keys).agg(
        F.count("*").alias("total"), n(now == "keep").alias("kept"), n(F.col("suggested_decision") == "exclude").alias("suggested_exclude"),
        n(F.col("label") == "uncertain").alias("uncertain"), n(now == "review").alias("review"), n(now == "exclude").alias("excluded"),
    )


def merged_candidates(given: DataFrame, presets: DataFrame, most: int = 3) -> DataFrame:
    """(album_id, nth, title): an album's titles in order, presets after them, the first of those equal without case; cut to `most`."""
    from pyspark.sql import Window

    albums = given.select("album_id").distinct()
    every = given.select("album_id", F.lit(0).alias("source"), "nth", "title").unionByName(albums.crossJoin(F.broadcast(presets.limit(24))).select("album_id", F.lit(1).alias("source"), "nth", "title"))
    name = F.lower(F.trim("title"))
    first = every.where(name != "").withColumn("seen", F.row_number().over(Window.partitionBy("album_id", name).orderBy("source", "nth"))).where("seen = 1")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("album_id").orderBy("source", "nth"))).where(F.col("nth") <= most).select("album_id", "nth", F.trim("title").alias("title"))


def best(photos: DataFrame, query_vector: Column, most: int) -> DataFrame:
    """The photos most similar to a vector: a top-k of the whole table, kept small in each task."""
    sim = vectors.cosine(vectors.normalized(vectors.doubles(F.col("embedding"))), query_vector)
    return photos.withColumn("similarity", sim).orderBy(F.desc_nulls_last("similarity"), "photo_id").limit(most)


def constraints(raw_years: Column, start: Column, end: Column, evidence: Column, request: Column) -> Column:
    """A theme's constraints: four-digit years that are given or that the request names, its dates before the given ones, and distinct evidence."""
    given = F.transform(F.filter(raw_years, lambda y: y.rlike("^[0-9]{4}$")), lambda y: y.cast("int"))
    asked, days = texts.years(request), texts.dates(request)
    sources = structures.some_texts(evidence, 20)
    return F.struct(
        F.array_sort(F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<int>")), asked))).alias("years"),
        F.coalesce(F.array_min(days), start).alias("start_date"), F.coalesce(F.array_max(days), end).alias("end_date"),
        F.when(F.nullif(request, F.lit("")).isNotNull(), F.array_distinct(F.concat(sources, F.array(F.lit("user_input"))))).otherwise(sources).alias("evidence"),
    )


def assessed(assessments: DataFrame, photos: DataFrame, key: str) -> DataFrame:
    """(key, excluded, review, coverage): ids by effective decision, ascending, and assessments for each photo."""
    now = F.coalesce(F.nullif("user_decision", F.lit("")), F.col("suggested_decision"))
    ids = lambda d: F.array_sort(F.collect_set(F.when(now == d, F.col("photo_id"))))
    by = assessments.groupBy(key).agg(ids("exclude").alias("excluded"), ids("review").alias("review"), F.count("*").alias("n"))
    size = photos.groupBy(key).agg(F.count("*").alias("size"))
    return by.join(size, key, "left").select(key, "excluded", "review", F.round(F.col("n") / F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)), 4).alias("coverage"))


def feature_summary(features: DataFrame, key: str) -> DataFrame:
    """(key, photos, embedded): photos of each album, and those that have an embedding with numbers in it."""
    return features.groupBy(key).agg(F.count("*").alias("photos"), F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("embedded"))


def with_complete_records(assessed: DataFrame, complete: Column) -> DataFrame:
    """relevance() rows, where those whose theme is the complete record are relevant and kept whatever their vectors and times."""
    over = {"score": F.lit(1.0), "label": F.lit("relevant"), "decision": F.lit("keep"), "reasons": F.array(F.lit("complete_record"))}
    return assessed.withColumns({c: F.when(complete, v).otherwise(F.col(c)) for c, v in over.items()})


def embedding_batches(responses: DataFrame, expected: DataFrame, dimension: int) -> DataFrame:
    """(batch, failure, vectors): answers of an embedding service, checked by batch; vectors are of unit length in order of index, null with a failure.

    responses(batch, index, embedding), expected(batch, n). A batch fails as a whole: on another number of answers, a vector of another
    length, one that is not finite, or of zeros. A missing index counts as 0."""
    v = vectors.doubles(F.col("embedding"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    why = F.when(F.coalesce(F.size(v), F.lit(-1)) != dimension, "dimension_mismatch").when(odd, "non_finite").when(vectors.norm(v) <= 0, "zero_vector")
    rows = responses.select("batch", F.coalesce("index", F.lit(0)).alias("index"), why.alias("why"), vectors.normalized(v).alias("unit"))
    # equal indices come in the order of their vectors, so that the result does not depend on the rows' order
    by = rows.groupBy("batch").agg(F.count("*").alias("n"), F.min_by("why", F.when(F.col("why").isNotNull(), F.struct("index", "why"))).alias("why"), F.transform(F.array_sort(F.collect_list(F.struct("index", "unit"))), lambda s: s["unit"]).alias("vectors"))
    out = expected.select("batch", F.col("n").alias("wanted")).join(by, "batch", "left")
    failure = F.when(~F.coalesce("n", F.lit(0)).eqNullSafe(F.col("wanted")), "count_mismatch").otherwise(F.col("why"))
    return out.select("batch", failure.alias("failure"), "vectors").withColumn("vectors", F.when(F.col("failure").isNull(), F.coalesce("vectors", F.array().cast("array<array<double>>"))))
