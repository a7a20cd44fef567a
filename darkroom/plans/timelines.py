"""Queries on time, place and similarity: events, chapters, themes, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions import geo, scoring, texts, times, vectors
from darkroom.operators import representatives as reps
from darkroom.operators import distances, theme, timeline
from darkroom.plans.analogs import EMBEDDED, JACCARD, PHOTOS, embedded, km, photos, piecewise, table, weighted

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STEPS = f"""{PHOTOS}, ordered AS (
  SELECT *, lag(photo_id) OVER w AS before FROM photos WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY album_id ORDER BY taken_at, photo_id)), stepped AS (
  SELECT o.album_id, o.photo_id, o.taken_at, o.lat, o.lon, o.tags, b.photo_id IS NOT NULL AS has, abs(epoch_us(o.taken_at) - epoch_us(b.taken_at)) / 3.6e9 AS gap, {km("b", "o")} AS far,
    {JACCARD.format(a="b.tags", b="o.tags")} AS scene FROM ordered o LEFT JOIN photos b ON b.album_id = o.album_id AND b.photo_id = o.before), scored AS (
  SELECT *, CASE WHEN gap IS NOT NULL THEN round(greatest(0.0, least(1.0, {weighted([(f"({piecewise('gap', scoring.BY_HOURS)})", 0.55), (f"({piecewise('far', scoring.BY_KM)})", 0.25), ("scene", 0.15)], "0.0")})), 4) END AS score FROM stepped), decided AS (
  SELECT *, CASE WHEN NOT has THEN false WHEN round(gap, 3) > 720 THEN true WHEN round(gap, 3) <= 2 AND NOT coalesce(round(far, 3) > 300, false) THEN false ELSE score < 0.45 END AS split,
    CASE WHEN NOT has THEN NULL WHEN round(gap, 3) > 720 THEN 'large_time_gap' WHEN round(gap, 3) <= 2 AND NOT coalesce(round(far, 3) > 300, false) THEN 'short_time_gap' WHEN score >= 0.45 THEN 'event_continuity' WHEN round(far, 3) > 50 THEN 'location_change'
      WHEN coalesce(round(scene, 4), 1.0) < 0.35 THEN 'visual_change' ELSE 'large_time_gap' END AS reason FROM scored), events2 AS (
  SELECT *, 1 + sum(split::INT) OVER (PARTITION BY album_id ORDER BY taken_at, photo_id ROWS UNBOUNDED PRECEDING) AS event FROM decided)"""


@query(f"WITH {STEPS} SELECT album_id, photo_id, round(gap, 3) AS gap_hours, round(far, 3) AS distance_km, score, split, reason, event::BIGINT AS event FROM events2")
def event_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.event_boundaries(photos(spark, sf_dir))
    return out.select("album_id", "photo_id", F.round("gap_hours", 3).alias("gap_hours"), F.round("distance_km", 3).alias("distance_km"), "score", "split", "reason", F.col("event").cast("long").alias("event"))


UNTIMED = f"""s0 AS (
  SELECT u.album_id, u.photo_id, m.event, max({piecewise("(" + km("u", "m") + ")", scoring.BY_KM)}) AS gps, max({JACCARD.format(a="u.tags", b="m.tags")}) AS scene
  FROM photos u JOIN events2 m ON m.album_id = u.album_id WHERE u.taken_at IS NULL GROUP BY ALL), p0 AS (
  SELECT *, {weighted([("gps", 0.45), ("scene", 0.35)])} AS profile FROM s0), r0 AS (
  SELECT *, row_number() OVER w AS n, coalesce(lead(profile) OVER w, 0) AS next FROM p0 WHERE profile IS NOT NULL WINDOW w AS (PARTITION BY album_id, photo_id ORDER BY profile DESC, event)), untimed AS (
  SELECT u.album_id, u.photo_id, CASE WHEN profile >= 0.60 AND profile - next >= 0.15 THEN event END::BIGINT AS event, round(profile, 6) AS profile FROM photos u LEFT JOIN r0 r ON r.album_id = u.album_id AND r.photo_id = u.photo_id AND n = 1 WHERE u.taken_at IS NULL)"""


@query(f"WITH {STEPS}, {UNTIMED} SELECT * FROM untimed")
def untimed_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    out = timeline.assign_untimed(rows.where("taken_at IS NULL"), timeline.event_boundaries(rows))
    return out.select("album_id", "photo_id", F.col("event").cast("long").alias("event"), F.round("profile", 6).alias("profile"))


@query(f"""WITH {EMBEDDED}, u AS (SELECT * FROM e WHERE photo_id % 7 = 0), m AS (SELECT *, photo_id % 4 + 1 AS event FROM e WHERE photo_id % 7 > 0), s AS (
  SELECT u.album_id, u.photo_id, m.event, max({piecewise("(" + km("u", "m") + ")", scoring.BY_KM)}) AS gps, max({JACCARD.format(a="u.scene", b="m.scene")}) AS scene, max(list_sum(list_transform(range(1, 49), lambda i: least(u.histogram[i], m.histogram[i]))) / 3) AS overlap
  FROM u JOIN m ON m.album_id = u.album_id GROUP BY ALL), p AS (SELECT *, {weighted([("gps", 0.45), ("scene", 0.35), ("overlap", 0.20)])} AS profile FROM s), r AS (
  SELECT *, row_number() OVER w AS n, coalesce(lead(profile) OVER w, 0) AS next FROM p WHERE profile IS NOT NULL WINDOW w AS (PARTITION BY album_id, photo_id ORDER BY profile DESC, event))
SELECT u.album_id, u.photo_id, CASE WHEN profile >= 0.40 AND profile - next >= 0.02 THEN event END::BIGINT AS event, round(profile, 6) AS profile FROM u LEFT JOIN r ON r.album_id = u.album_id AND r.photo_id = u.photo_id AND n = 1""")
def untimed_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    events = rows.where("photo_id % 7 > 0").withColumn("event", F.col("photo_id") % 4 + 1)
    out = timeline.assign_untimed(rows.where("photo_id % 7 = 0"), events, 0.40, 0.02)
    return out.select("album_id", "photo_id", F.col("event").cast("long").alias("event"), F.round("profile", 6).alias("profile"))


@query("""WITH p AS (SELECT user_id AS album_id, event_type, min(ts) AS a, max(ts) AS b FROM events WHERE event_id % 11 <> 0 GROUP BY ALL)
SELECT album_id, event_type, CASE WHEN year(a) = year(b) AND month(a) = month(b) AND day(a) = day(b) THEN year(a) || '年' || month(a) || '月' || day(a) || '日'
  WHEN year(a) = year(b) AND month(a) = month(b) THEN year(a) || '年' || month(a) || '月' || day(a) || '-' || day(b) || '日' WHEN year(a) = year(b) THEN year(a) || '年' || month(a) || '-' || month(b) || '月' ELSE year(a) || '-' || year(b) END AS label FROM p""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").where("event_id % 11 <> 0").groupBy(F.col("user_id").alias("album_id"), "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return by.select("album_id", "event_type", times.range_label(F.col("a"), F.col("b")).alias("label"))


SCALE = "CASE WHEN count(*) FILTER (WHERE {x} > 0) = 0 THEN 1.0 ELSE greatest(quantile_cont({x}, 0.75) FILTER (WHERE {x} > 0) - quantile_cont({x}, 0.25) FILTER (WHERE {x} > 0), quantile_cont({x}, 0.5) FILTER (WHERE {x} > 0), 1e-9) END"

PAIRS = f"""{EMBEDDED}, pairs0 AS (
  SELECT p.album_id, p.photo_id AS a, q.photo_id AS b, greatest(0.0, least(1.0, (1 - list_dot_product(p.unit, q.unit)) / 2)) AS embedding, abs(epoch_us(p.taken_at) - epoch_us(q.taken_at)) / 1e6 AS seconds, {km("p", "q")} AS km,
    sqrt(list_sum(list_transform(range(1, 49), lambda i: pow(sqrt(p.histogram[i]) - sqrt(q.histogram[i]), 2))) / 2) AS color
  FROM e p JOIN e q ON p.album_id = q.album_id AND p.photo_id < q.photo_id), scales AS (
  SELECT album_id, {SCALE.format(x="seconds")} AS ts, {SCALE.format(x="km")} AS gs FROM pairs0 GROUP BY album_id), pairs1 AS (
  SELECT p.*, seconds / (seconds + ts) AS time, km / (km + gs) AS gps FROM pairs0 p JOIN scales USING (album_id)), pairs AS (
  SELECT *, greatest(0.0, least(1.0, {weighted([("embedding", 0.60), ("time", 0.20), ("gps", 0.10), ("color", 0.10)], "1.0")})) AS distance FROM pairs1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.pair_distances(embedded(spark, sf_dir), timeline.STRATEGIES["balanced"])


@query(f"WITH {PAIRS} SELECT album_id, a, b, round(embedding, 5) AS embedding, round(time, 5) AS time, round(gps, 5) AS gps, round(color, 5) AS color, round(distance, 5) AS distance FROM pairs")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("album_id", "a", "b", *(F.round(c, 5).alias(c) for c in ("embedding", "time", "gps", "color", "distance")))


@query(f"WITH {PAIRS} SELECT album_id, count(*) AS pairs, " + ", ".join(f"round(avg(({c} IS NOT NULL)::INT), 4) AS {c}" for c in ("embedding", "time", "gps", "color")) + " FROM pairs GROUP BY album_id")
def channel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.coverage(embedded(spark, sf_dir))


LABELS = "labels2 AS (SELECT album_id, photo_id, photo_id // 40 % 3 AS label FROM e)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).select("album_id", "photo_id", (F.floor(F.col("photo_id") / 40) % 3).alias("label"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.label_sums(embedded(spark, sf_dir), labels(spark, sf_dir), timeline.STRATEGIES["balanced"])


@query(f"WITH {PAIRS} SELECT album_id, round(ts, 5) AS time_scale, round(gs, 5) AS gps_scale FROM scales")
def album_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.scales(embedded(spark, sf_dir)).select("album_id", F.round("time_scale", 5).alias("time_scale"), F.round("gps_scale", 5).alias("gps_scale"))


@query("""WITH w AS (SELECT epoch_us(ts) AS at, event_type AS album_id FROM events), p AS (
  SELECT x.album_id, abs(x.at - y.at) / 1e6 AS d FROM w x JOIN w y ON x.album_id = y.album_id AND x.at < y.at)
SELECT w.album_id, greatest(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), quantile_cont(d, 0.5)) AS time_scale FROM (SELECT DISTINCT album_id FROM w) w JOIN p USING (album_id) GROUP BY w.album_id""")
def large_time_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.time_scales(table(spark, sf_dir, "events").select(F.col("event_type").alias("album_id"), F.col("ts").alias("taken_at")))


@query(f"""WITH {PAIRS}, {LABELS}, n AS (SELECT album_id, label, count(*) AS n FROM labels2 GROUP BY ALL), d AS (
  SELECT p.album_id, sum(distance / n) AS d FROM pairs p JOIN labels2 x ON x.photo_id = p.a JOIN labels2 y ON y.photo_id = p.b JOIN n ON n.album_id = p.album_id AND n.label = x.label WHERE x.label = y.label GROUP BY p.album_id)
SELECT DISTINCT l.album_id, round(greatest(coalesce(d, 0), 1e-12), 5) AS dispersion FROM labels2 l LEFT JOIN d USING (album_id)""")
def cluster_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.dispersion(sums(spark, sf_dir), labels(spark, sf_dir))
    return out.select("album_id", F.round("dispersion", 5).alias("dispersion"))


@query(f"""WITH {PAIRS}, {LABELS}, two AS (SELECT album_id, a, b, distance FROM pairs UNION ALL SELECT album_id, b, a, distance FROM pairs), m AS (
  SELECT t.album_id, t.a, x.label AS la, y.label AS lb, avg(distance) AS d FROM two t JOIN labels2 x ON x.photo_id = t.a JOIN labels2 y ON y.photo_id = t.b GROUP BY ALL), s AS (
  SELECT album_id, a, max(CASE WHEN la = lb THEN d END) AS i, min(CASE WHEN la <> lb THEN d END) AS o FROM m GROUP BY ALL)
SELECT l.album_id, l.photo_id, round(coalesce(CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE (o - i) / nullif(greatest(o, i), 0) END, 0), 5) AS silhouette FROM labels2 l LEFT JOIN s ON s.a = l.photo_id""")
def cluster_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.silhouette(sums(spark, sf_dir), labels(spark, sf_dir))
    return out.select("album_id", "photo_id", F.round("silhouette", 5).alias("silhouette"))


@query("""WITH g AS (SELECT user_id AS album_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS k, avg(value) AS gap, stddev_samp(value) / 10 AS error FROM events GROUP BY user_id, event_type),
t AS (SELECT *, first_value(gap) OVER w AS pg, first_value(error) OVER w AS pe, first_value(k) OVER w AS pk FROM g WINDOW w AS (PARTITION BY album_id ORDER BY gap DESC, k))
SELECT album_id, min(k) AS selected, any_value(pk) AS peak FROM t WHERE pg - gap <= sqrt(pe * pe + error * error) GROUP BY album_id""")
def chapter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("album_id"), "event_type").agg(F.avg("value").alias("gap"), (F.stddev_samp("value") / 10).alias("error"))
    gaps = by.withColumn("k", F.dense_rank().over(Window.partitionBy("album_id").orderBy("event_type")))
    return timeline.chosen_k(gaps).select("album_id", F.col("selected").cast("long").alias("selected"), F.col("peak").cast("long").alias("peak"))


@query()
def sequential_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sequential(embedded(spark, sf_dir))


VISUAL = "greatest(0.0, least(1.0, (list_dot_product(p.embedding, q.embedding) - 0.2) / 0.75))"

FIRST = f"""{EMBEDDED}, typical AS (
  SELECT p.photo_id, avg({VISUAL}) AS t FROM e p JOIN e q ON p.album_id = q.album_id AND p.photo_id <> q.photo_id GROUP BY p.photo_id), ranked AS (
  SELECT e.*, coalesce(t, 0.5) AS typicality, 0.5 * quality / 10 + 0.3 * coalesce(t, 0.5) + 0.2 * ((taken_at IS NOT NULL)::INT + (lat IS NOT NULL)::INT + 1) / 3 AS score FROM e LEFT JOIN typical USING (photo_id)), picked AS (
  SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY score DESC, taken_at ASC NULLS LAST, photo_id::VARCHAR) AS n FROM ranked)"""


@query(f"WITH {FIRST} SELECT album_id, photo_id, round(typicality, 5) AS typicality, round(score, 5) AS score FROM picked WHERE n = 1")
def first_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reps.first_picks(embedded(spark, sf_dir), "album_id").select("album_id", "photo_id", F.round("typicality", 5).alias("typicality"), F.round("score", 5).alias("score"))


NEXT = """n{i} AS (SELECT album_id, photo_id, row_number() OVER (PARTITION BY album_id ORDER BY s DESC, taken_at ASC NULLS LAST, photo_id::VARCHAR) AS n FROM (
  SELECT p.album_id, p.photo_id, p.taken_at, 0.45 * any_value(p.quality) / 10 + 0.25 * (1 - max({j})) + 0.15 * coalesce(CASE WHEN (tg IS NULL) AND (dg IS NULL) THEN 0.5 ELSE (coalesce(tg, 0) + coalesce(dg, 0)) / ((tg IS NOT NULL)::INT + (dg IS NOT NULL)::INT) END, 0.5) + 0.15 * (1 - max({v})) AS s
  FROM (SELECT p.*, least(1.0, min(abs(epoch_us(p.taken_at) - epoch_us(q.taken_at)) / 1e6 / sp) OVER w) AS tg, least(1.0, min({km} / 300) OVER w) AS dg, q.scene AS qs, q.embedding AS qe
    FROM e p JOIN {chosen} c ON c.album_id = p.album_id JOIN e q ON q.photo_id = c.photo_id JOIN span s ON s.album_id = p.album_id WINDOW w AS (PARTITION BY p.photo_id)) p
  WHERE p.photo_id NOT IN (SELECT photo_id FROM {chosen}) GROUP BY p.album_id, p.photo_id, p.taken_at, tg, dg)), c{i} AS (SELECT album_id, photo_id, nth FROM {chosen} UNION ALL SELECT album_id, photo_id, {i} AS nth FROM n{i} WHERE n = 1)"""


def _next(i: int, chosen: str) -> str:
    return NEXT.format(i=i, chosen=chosen, km=km("p", "q"), j=JACCARD.format(a="p.scene", b="p.qs"), v=VISUAL.replace("q.embedding", "p.qe"))


@query(f"""WITH {FIRST}, span AS (SELECT album_id, CASE WHEN count(taken_at) > 1 THEN greatest(1.0, (epoch_us(max(taken_at)) - epoch_us(min(taken_at))) / 1e6) END AS sp FROM e GROUP BY album_id),
c1 AS (SELECT album_id, photo_id, 1 AS nth FROM picked WHERE n = 1), {_next(2, "c1")}, {_next(3, "c2")} SELECT album_id, nth, photo_id FROM c3""")
def representative_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reps.representatives(embedded(spark, sf_dir), "album_id")


@query(f"""WITH {PHOTOS} SELECT p.album_id, p.photo_id, round({km("p", "q")}, 4) AS km, round({JACCARD.format(a="p.tags", b="q.tags")}, 6) AS tags FROM photos p JOIN photos q ON q.photo_id = p.photo_id + 1""")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = photos(spark, sf_dir).alias("p"), photos(spark, sf_dir).alias("q")
    both = a.join(b, F.col("q.photo_id") == F.col("p.photo_id") + 1)
    far = geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"))
    return both.select("p.album_id", "p.photo_id", F.round(far, 4).alias("km"), F.round(texts.jaccard(texts.scene_tags(F.col("p.tags")), texts.scene_tags(F.col("q.tags"))), 6).alias("tags"))


THEME = f"""{EMBEDDED}, q AS (SELECT (SELECT unit FROM e WHERE photo_id = 0) AS u, (SELECT list(unit) FROM e WHERE photo_id IN (2, 3)) AS ex, (SELECT list(unit) FROM e WHERE photo_id IN (4, 5)) AS ng), s0 AS (
  SELECT album_id, photo_id, taken_at, label, greatest(-1.0, least(1.0, list_dot_product(unit, u))) AS raw, list_avg(list_transform(ex, lambda v: greatest(-1.0, least(1.0, list_dot_product(unit, v))))) AS expanded,
    list_max(list_transform(ng, lambda v: greatest(-1.0, least(1.0, list_dot_product(unit, v))))) AS negative FROM e, q), s1 AS (
  SELECT *, 0.7 * raw + 0.3 * expanded AS positive FROM s0), s2 AS (
  SELECT *, positive - 0.5 * greatest(0.0, coalesce(nullif(negative, 0), -1.0) - positive) AS signal FROM s1), s3 AS (
  SELECT *, greatest(0.0, least(1.0, (signal + 1) / 2)) AS rank, CASE WHEN taken_at IS NULL THEN 'review' WHEN month(taken_at) = 2 AND day(taken_at) > 10 OR month(taken_at) > 2 THEN 'dates' ELSE 'match' END AS forced FROM s2), s4 AS (
  SELECT *, CASE WHEN label = 4 THEN 'review' WHEN forced = 'review' THEN 'review' WHEN forced = 'dates' OR rank < 0.55 THEN 'exclude' ELSE 'keep' END AS decision,
    CASE WHEN label = 4 THEN 0.5 WHEN forced = 'review' THEN rank WHEN forced = 'dates' THEN 0.0 ELSE rank END AS score FROM s3), theme AS (
  SELECT *, CASE decision WHEN 'keep' THEN 'relevant' WHEN 'exclude' THEN 'off_theme' ELSE 'uncertain' END AS relevance,
    array_to_string(list_filter([CASE forced WHEN 'review' THEN 'missing_capture_time' WHEN 'dates' THEN 'outside_requested_date_range' ELSE 'matched_time_constraint' END, CASE WHEN label = 4 THEN 'embedding_model_mismatch' END,
      CASE WHEN label <> 4 AND forced = 'match' THEN CASE WHEN rank >= 0.55 THEN 'provisional_threshold_match' ELSE 'provisional_threshold_mismatch' END END,
      CASE WHEN label <> 4 AND forced = 'match' THEN 'provisional_threshold' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s4)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir).withColumns({"provider": F.lit("local"), "model": F.when(F.col("label") == 4, "other").otherwise("one")})
    unit = vectors.normalized(F.col("embedding"))
    only = lambda *ids: F.array_compact(F.collect_list(F.when(F.col("photo_id").isin(*ids), unit)))
    q = rows.where("photo_id < 6").agg(
        only(0)[0].alias("positive"), only(2, 3).alias("expansions"), only(4, 5).alias("negatives"), F.lit("local").alias("provider"), F.lit("one").alias("model"),
        F.array().cast("array<int>").alias("years"), F.lit("2024-01-01").cast("date").alias("start"), F.lit("2024-02-10").cast("date").alias("end"),
    )
    return theme.relevance(rows.withColumnRenamed("label", "class"), q, threshold=0.55)


@query(f"WITH {THEME} SELECT album_id, photo_id, round(positive, 5) AS positive, round(negative, 5) AS negative, round(signal, 5) AS signal, round(score, 5) AS score, relevance AS label, decision, reasons FROM theme")
def theme_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assessed(spark, sf_dir)
    return out.select("album_id", "photo_id", *(F.round(c, 5).alias(c) for c in ("positive", "negative", "signal", "score")), "label", "decision", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {THEME}, a AS (SELECT *, CASE WHEN photo_id % 9 = 0 THEN 'keep' WHEN photo_id % 9 = 1 THEN '' END AS mine FROM theme), n AS (SELECT *, coalesce(nullif(mine, ''), decision) AS now FROM a)
SELECT album_id, count(*) AS total, count_if(now = 'keep')::BIGINT AS kept, count_if(decision = 'exclude')::BIGINT AS suggested_exclude, count_if(relevance = 'uncertain')::BIGINT AS uncertain, count_if(now = 'review')::BIGINT AS review, count_if(now = 'exclude')::BIGINT AS excluded FROM n GROUP BY album_id""")
def theme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir).withColumns({"suggested_decision": F.col("decision"), "user_decision": F.when(F.col("photo_id") % 9 == 0, "keep").when(F.col("photo_id") % 9 == 1, "")})
    return theme.summary(rows, "album_id")


@query(f"WITH {EMBEDDED} SELECT photo_id, round(list_dot_product(unit, (SELECT unit FROM e WHERE photo_id = 0)), 5) AS similarity FROM e ORDER BY list_dot_product(unit, (SELECT unit FROM e WHERE photo_id = 0)) DESC, photo_id LIMIT 20")
def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    q = rows.where("photo_id = 0").select(vectors.normalized(F.col("embedding")).alias("q"))
    return theme.best(rows.crossJoin(F.broadcast(q)), F.col("q"), 20).select("photo_id", F.round("similarity", 5).alias("similarity"))
