"""Queries on duplicates, decisions and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import decisions
from darkroom.operators import duplicates, review
from darkroom.plans.analogs import EMBEDDED, PHOTOS, embedded, photos, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("album_id"), F.col("doc_id").alias("photo_id"), F.sha2("text", 256).alias("sha"))


@query("""
WITH d AS (SELECT source AS album_id, doc_id AS photo_id, sha256(text) AS sha FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY album_id, sha) AS copies, row_number() OVER (PARTITION BY album_id, sha ORDER BY photo_id) AS rank FROM d)
SELECT album_id, photo_id, copies, rank, CASE WHEN rank = 1 THEN 'keep' ELSE 'remove' END AS decision FROM r WHERE copies > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(documents(spark, sf_dir)).select("album_id", "photo_id", "copies", "rank", "decision")


CANDIDATES = f"""{EMBEDDED}, bands AS (
  SELECT album_id, photo_id, bits, o AS band, substr(bits, greatest(0, 64 - o - 5) + 1, least(5, 64 - o)) AS value FROM e, (SELECT unnest(range(0, 64, 5)) AS o)), placed AS (
  SELECT *, row_number() OVER (PARTITION BY album_id, band, value ORDER BY bits, photo_id) AS n FROM bands), candidates AS (
  SELECT DISTINCT x.album_id, least(x.photo_id, y.photo_id) AS a, greatest(x.photo_id, y.photo_id) AS b
  FROM placed x JOIN placed y ON x.album_id = y.album_id AND x.band = y.band AND x.value = y.value AND y.n > x.n AND y.n <= x.n + 8 AND x.bits <> y.bits)"""


@query(f"WITH {CANDIDATES} SELECT * FROM candidates")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.candidates(embedded(spark, sf_dir))


#: The vectors hold no near copies, so these thresholds are wider than an album's.
WIDE_NEAR = {"hamming": 22, "aspect": 0.5, "histogram": 0.20}
WIDE_BURST = {"hamming": 26, "aspect": 0.6, "histogram": 0.30, "ms": 3_600_000 * 24 * 3}

RELATIONS = f"""{CANDIDATES}, measured AS (
  SELECT c.*, p.device AS da, q.device AS db, (64 - list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p.bits[i] = q.bits[i] THEN 1 ELSE 0 END)))::INT AS hamming,
    list_sum(list_transform(range(1, 49), lambda i: abs(p.histogram[i] - q.histogram[i]))) / 6 AS histogram_distance, abs(p.aspect - q.aspect) / greatest(p.aspect, q.aspect) AS aspect_delta,
    abs(epoch_us(p.taken_at) - epoch_us(q.taken_at)) // 1000 AS delta_ms
  FROM candidates c JOIN e p ON p.album_id = c.album_id AND p.photo_id = c.a JOIN e q ON q.album_id = c.album_id AND q.photo_id = c.b), related AS (
  SELECT *, CASE WHEN hamming <= 22 AND aspect_delta <= 0.5 AND histogram_distance <= 0.20 THEN 'near'
    WHEN delta_ms <= 259200000 AND da = db AND hamming <= 26 AND aspect_delta <= 0.6 AND histogram_distance <= 0.30 THEN 'burst' END AS relation FROM measured)"""


@query(f"WITH {RELATIONS} SELECT album_id, a, b, relation, hamming, round(histogram_distance, 6) AS histogram_distance, round(aspect_delta, 6) AS aspect_delta, delta_ms FROM related")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    out = duplicates.relations(duplicates.candidates(rows), rows, WIDE_NEAR, WIDE_BURST)
    return out.select("album_id", "a", "b", "relation", "hamming", F.round("histogram_distance", 6).alias("histogram_distance"), F.round("aspect_delta", 6).alias("aspect_delta"), "delta_ms")


@query()
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    return duplicates.complete_link(rows, duplicates.relations(duplicates.candidates(rows), rows, WIDE_NEAR, WIDE_BURST))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos grouped by device."""
    return photos(spark, sf_dir).withColumns({"group_id": F.col("device"), "sha": F.concat("device", (F.col("photo_id") % 9).cast("string")), "hard_reject": F.col("photo_id") % 17 == 0, "confidence": F.lit(None).cast("double"), "faces": F.struct(*((F.col("photo_id") % (3 + n)).alias(f) for n, f in enumerate(("detected", "clarity_p20", "closed_eye", "occlusion", "edge_crop", "expression"))))})


RANKED = f"""{PHOTOS}, m AS (
  SELECT *, device AS group_id, device || (photo_id % 9) AS sha, photo_id % 17 = 0 AS hard_reject FROM photos), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY album_id, group_id ORDER BY hard_reject, photo_id % 3 DESC, photo_id % 4 DESC, photo_id % 5, photo_id % 6, photo_id % 7, photo_id % 8, quality DESC, width * height DESC, uploaded_at, photo_id) AS rank FROM m), r AS (
  SELECT *, row_number() OVER (PARTITION BY album_id, group_id, sha ORDER BY rank) AS exact_rank, first_value(photo_id) OVER (PARTITION BY album_id, group_id ORDER BY rank) AS preferred FROM ranked)"""


@query(f"WITH {RANKED} SELECT album_id, group_id, photo_id, rank, exact_rank, preferred FROM r")
def preferred_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.ranked(members(spark, sf_dir)).select("album_id", "group_id", "photo_id", "rank", "exact_rank", "preferred")


def related_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("photo_id")
    return duplicates.ranked(members(spark, sf_dir)).withColumns({"relation": F.when(i % 3 == 0, "near").when(i % 3 == 1, "burst"), "hamming": (i % 7).cast("int"), "histogram_distance": (i % 13).cast("double") / 100})


DECIDED = f"""{RANKED}, rel AS (
  SELECT *, CASE photo_id % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'burst' END AS relation, photo_id % 7 AS hamming, (photo_id % 13)::DOUBLE / 100 AS hist FROM r), c AS (
  SELECT *, coalesce(relation = 'near' AND hamming <= 4 AND coalesce(nullif(hist, 0), 1) <= 0.10, false) AS close FROM rel)"""


@query(f"""WITH {DECIDED} SELECT album_id, group_id, photo_id,
  CASE WHEN hard_reject THEN 'remove' WHEN rank = 1 THEN 'keep' WHEN exact_rank > 1 OR close THEN 'remove' ELSE 'review' END AS suggestion,
  CASE WHEN hard_reject THEN 0.99 WHEN rank = 1 THEN 0.95 WHEN exact_rank > 1 THEN 1.0 WHEN close THEN 0.9 ELSE 0.75 END AS confidence,
  CASE WHEN hard_reject THEN 'system_unrecoverable_blur' WHEN rank > 1 AND exact_rank > 1 THEN 'system_exact_duplicate' END AS exclusion FROM c""")
def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicates.decided(related_members(spark, sf_dir), exclude_rejected=True)
    return out.select("album_id", "group_id", "photo_id", "suggestion", "confidence", "exclusion")


@query(f"""WITH {DECIDED}, s AS (SELECT album_id, group_id, list_distinct(list(CASE WHEN exact_rank > 1 THEN 'exact' END) || list(CASE WHEN rank > 1 THEN relation END)) AS kinds, count(*) AS members,
  sum(CASE WHEN rank = 1 OR exact_rank > 1 OR relation IS NULL THEN 12 WHEN relation = 'near' THEN greatest(0, 12 - 2 * hamming) ELSE greatest(0, 12 - hamming) END)::BIGINT * 10000 AS trust, count(*) * 12 AS whole FROM c GROUP BY ALL),
h AS (SELECT *, trust // whole AS low, 2 * (trust % whole) AS twice FROM s)
SELECT album_id, group_id, (low + CASE WHEN twice > whole OR twice = whole AND low % 2 = 1 THEN 1 ELSE 0 END) / 10000 AS confidence, members, CASE WHEN len(list_filter(kinds, lambda x: x IS NOT NULL)) = 1 THEN list_filter(kinds, lambda x: x IS NOT NULL)[1] ELSE 'mixed' END AS group_type FROM h""")
def duplicate_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.group_summary(related_members(spark, sf_dir))


STATUS = "CASE WHEN decision = 'remove' THEN 'removed' WHEN decision = 'keep' THEN 'kept' WHEN suggestion IN ('review', 'remove') THEN 'pending_review' WHEN suggestion = 'keep' THEN 'included' ELSE 'unanalyzed' END"


@query(f"""WITH {PHOTOS}, s AS (SELECT *, {STATUS} AS status FROM photos)
SELECT album_id, count(*) AS total, count_if(suggestion = 'keep')::BIGINT AS suggested_keep, count_if(suggestion = 'review')::BIGINT AS suggested_review, count_if(suggestion = 'remove')::BIGINT AS suggested_remove,
  count_if(status = 'pending_review')::BIGINT AS pending, count_if(status = 'kept')::BIGINT AS kept, count_if(status = 'removed')::BIGINT AS removed, count_if(status = 'unanalyzed')::BIGINT AS unanalyzed,
  count_if(decision IS DISTINCT FROM 'remove')::BIGINT AS included FROM s GROUP BY album_id""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(photos(spark, sf_dir))


@query(f"WITH {PHOTOS} SELECT album_id, photo_id, {STATUS} AS status FROM photos WHERE decision IS DISTINCT FROM 'remove'")
def included_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).where(decisions.included(F.col("decision")))
    return rows.select("album_id", "photo_id", decisions.review_status(F.col("decision"), F.col("suggestion")).alias("status"))


@query(f"""WITH {PHOTOS}, g AS (SELECT album_id, device AS group_id, (count(*) % 4)::DOUBLE / 4 + 0.1 AS confidence FROM photos WHERE photo_id % 3 = 0 GROUP BY ALL),
m AS (SELECT *, device AS group_id, CASE WHEN decision IS NULL AND suggestion IN ('review', 'remove') THEN 1 ELSE 0 END AS pending FROM photos),
q AS (
  SELECT m.album_id, 'group:' || m.group_id AS item, 'duplicate_group' AS kind, array_to_string(list(photo_id ORDER BY quality, photo_id), ',') AS photo_ids,
    list_sort(list_distinct(flatten(list(issues)) || ['duplicate_near'])) AS reasons, CASE WHEN any_value(confidence) >= 0.8 THEN 'accept_preferred' ELSE 'keep_all' END AS action
  FROM m JOIN g USING (album_id, group_id) WHERE photo_id % 3 = 0 GROUP BY m.album_id, m.group_id HAVING sum(pending) > 0
  UNION ALL
  SELECT album_id, 'photo:' || photo_id, 'single_photo', photo_id::VARCHAR, list_sort(issues), CASE WHEN suggestion = 'remove' THEN 'remove' ELSE 'keep' END
  FROM m WHERE pending = 1 AND photo_id % 3 <> 0)
SELECT album_id, item, kind, photo_ids, array_to_string(reasons, ',') AS reasons, action,
  CASE WHEN list_contains(reasons, 'analysis_failed') THEN 100 WHEN list_contains(reasons, 'closed_eyes_suspected') THEN 80 WHEN kind = 'duplicate_group' THEN 70 WHEN list_contains(reasons, 'sharpness_severe') THEN 65 ELSE 50 END AS priority FROM q""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    part = rows.where("photo_id % 3 = 0").withColumnRenamed("device", "group_id")
    groups = part.groupBy("album_id", "group_id").agg(((F.count("*") % 4).cast("double") / 4 + 0.1).alias("confidence")).withColumn("group_type", F.lit("near"))
    out = review.queue(rows.drop("group_id"), groups, part.select("album_id", "group_id", "photo_id", F.col("quality").alias("rank")))
    return out.select("album_id", "item", "kind", F.array_join(F.col("photo_ids").cast("array<string>"), ",").alias("photo_ids"), F.array_join("reasons", ",").alias("reasons"), "action", "priority")


@query(f"""WITH {PHOTOS} SELECT album_id, photo_id, decision AS before, suggestion AS after, 'system' AS source_before, 'user' AS source_after FROM photos WHERE suggestion IS NOT NULL""")
def decision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    wanted = rows.where("suggestion IS NOT NULL").select("album_id", "photo_id", F.col("suggestion").alias("decision"), F.lit("user").alias("source"))
    return review.changes(rows.select("album_id", "photo_id", "decision", F.lit("system").alias("source")), wanted)


@query("""SELECT DISTINCT user_id, ('0x' || substr(sha256('rollout:' || user_id), 1, 4))::UBIGINT::BIGINT % 100 AS bucket, ('0x' || substr(sha256('rollout:' || user_id), 1, 4))::UBIGINT % 100 < 25 AS enabled,
  ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::UBIGINT % 5 = 0 AS validation FROM events""")
def rollout_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", decisions.bucket(key, "rollout:", 4, 100).alias("bucket"), decisions.in_rollout(key, "rollout:", 25).alias("enabled"), decisions.validation_fold(key).alias("validation"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'A5' ELSE 'A4' END AS book_size, least(8.0, greatest(0.0, p_size::DOUBLE / 4)) AS bleed_mm, 8.0 AS safe_margin_mm, least(600, greatest(150, p_size * 20)) AS page_dpi, 'rgb' AS color_profile,
  array_to_string(list_filter([CASE WHEN p_size % 3 = 1 THEN 'book_size' END, 'safe_margin_mm', CASE WHEN p_size % 2 = 1 THEN 'color_profile' END], lambda x: x IS NOT NULL), ',') AS warnings FROM part""")
def print_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    size = F.when(n % 3 == 0, "A5").when(n % 3 == 1, "Folio")
    spec = decisions.print_spec(size, (n / 4).cast("string"), F.lit("wide"), (n * 20).cast("string"), F.when(n % 2 == 1, "Pantone"))
    return table(spark, sf_dir, "part").select("p_partkey", spec.alias("s")).select("p_partkey", "s.book_size", "s.bleed_mm", "s.safe_margin_mm", "s.page_dpi", "s.color_profile", F.array_join("s.warnings", ",").alias("warnings"))
