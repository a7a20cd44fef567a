"""Queries on what albums serve: lists, views, names, requests, tokens, books, captured fields and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions import decisions, scoring, structures, texts, times
from darkroom.operators import control, evaluation, images, layout, lifecycle, review, theme, timeline
from darkroom.plans.albums import PAGED, paged
from darkroom.plans.analogs import PHOTOS, dealt, photos, table
from darkroom.sources import manifests, media, tables
from darkroom.streaming import rules

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text_of(column: str) -> F.Column:
    return F.col(column).cast("string")


# ---- review ----

GROUPED = f"""{PHOTOS}, g AS (SELECT album_id, device AS group_id, min(photo_id) AS preferred, CASE WHEN count(*) % 2 = 0 THEN 0.9 ELSE 0.5 END AS confidence, count_if(decision IS NULL AND coalesce(suggestion IN ('review', 'remove'), false)) AS pending
  FROM photos GROUP BY ALL HAVING count(*) >= 2)"""


def grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photos, and those of one album and device as groups of duplicates with their members."""
    rows = photos(spark, sf_dir)
    by = rows.groupBy("album_id", F.col("device").alias("group_id")).agg(F.min("photo_id").alias("preferred"), F.count("*").alias("n")).where("n >= 2")
    groups = by.select("album_id", "group_id", "preferred", F.when(F.col("n") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), F.lit("near").alias("group_type"))
    members = rows.select("album_id", F.col("device").alias("group_id"), "photo_id").join(by.select("album_id", "group_id"), ["album_id", "group_id"])
    return rows, groups, members.withColumn("rank", F.row_number().over(Window.partitionBy("album_id", "group_id").orderBy("photo_id")))


@query(f"""WITH {GROUPED} SELECT album_id, photo_id, CASE WHEN photo_id % 2 = 0 THEN 'remove' ELSE 'keep' END AS decision, 'user' AS source FROM photos WHERE photo_id % 4 < 2
UNION ALL SELECT p.album_id, p.photo_id, CASE WHEN g.confidence > 0.8 AND p.photo_id <> g.preferred THEN 'remove' ELSE 'keep' END, 'user' FROM photos p JOIN g ON g.album_id = p.album_id AND g.group_id = p.device""")
def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, groups, members = grouped(spark, sf_dir)
    i = F.col("photo_id")
    one = rows.select("album_id", F.concat(F.lit("photo:"), text_of("photo_id")).alias("item"), F.when(i % 4 == 0, "remove").when(i % 4 == 1, "keep").when(i % 4 == 2, "keep_all").otherwise("unknown").alias("action"))
    many = groups.select("album_id", F.concat(F.lit("group:"), "group_id").alias("item"), F.when(F.col("confidence") > 0.8, "accept_preferred").otherwise("keep_all").alias("action"))
    return review.resolved(rows, groups, members, one.unionByName(many))


@query(f"""WITH {GROUPED} SELECT p.album_id, p.photo_id, CASE WHEN g.confidence >= 0.8 AND p.photo_id <> g.preferred THEN 'remove' ELSE 'keep' END AS decision, 'user_delegated' AS source
FROM photos p JOIN g ON g.album_id = p.album_id AND g.group_id = p.device AND g.pending > 0 WHERE p.decision IS NULL
UNION ALL SELECT p.album_id, p.photo_id, CASE WHEN p.suggestion = 'remove' THEN 'remove' ELSE 'keep' END, 'user_delegated' FROM photos p LEFT JOIN g ON g.album_id = p.album_id AND g.group_id = p.device
WHERE g.album_id IS NULL AND p.decision IS NULL AND p.suggestion IN ('review', 'remove')""")
def resolved_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.resolved_remaining(*grouped(spark, sf_dir))


@query(f"""WITH {PHOTOS}, s AS (SELECT *, CASE photo_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'system' END AS source FROM photos)
SELECT album_id, photo_id, NULL::DOUBLE AS quality, NULL::VARCHAR AS suggestion, CASE WHEN source = 'user' THEN decision END AS decision, CASE WHEN source = 'user' THEN source END AS source FROM s""")
def reset_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("photo_id")
    rows = photos(spark, sf_dir).select("album_id", "photo_id", "quality", "suggestion", "decision", F.when(i % 3 == 0, "user").when(i % 3 == 1, "system").alias("source"))
    return review.reset(rows, ["quality", "suggestion"])


@query(f"WITH {PHOTOS} SELECT album_id, photo_id, decision IS DISTINCT FROM 'remove' AS kept, decision IS NOT DISTINCT FROM 'remove' AS removed FROM photos")
def chosen_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("decision")
    return photos(spark, sf_dir).where(decisions.chosen(d, "all")).select("album_id", "photo_id", decisions.chosen(d, "keep").alias("kept"), decisions.chosen(d, "remove").alias("removed"))


# ---- themes ----


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 1.0 ELSE round(least(value, 100) / 100, 4) END AS score, CASE WHEN event_type = 'view' OR value >= 60 THEN 'relevant' ELSE 'off_theme' END AS label,
  CASE WHEN event_type = 'view' OR value >= 60 THEN 'keep' ELSE 'exclude' END AS decision, CASE WHEN event_type = 'view' THEN 'complete_record' ELSE 'provisional_threshold' END AS reasons FROM events""")
def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("value") >= 60
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.least("value", F.lit(100.0)) / 100, 4).alias("score"), F.when(good, "relevant").otherwise("off_theme").alias("label"), F.when(good, "keep").otherwise("exclude").alias("decision"), F.array(F.lit("provisional_threshold")).alias("reasons"))
    return theme.with_complete_records(rows, F.col("event_type") == "view").select("event_id", "score", "label", "decision", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH e AS (SELECT vec_id // 8 AS batch, vec_id % 8 AS index, CASE WHEN vec_id % 97 = 3 THEN list_transform(embedding[1:10], lambda x: x::DOUBLE) WHEN vec_id % 89 = 5 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) WHEN vec_id % 83 = 7 THEN list_transform(embedding, lambda x: 'inf'::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
r AS (SELECT *, CASE WHEN len(v) <> 64 THEN 'dimension_mismatch' WHEN isinf(v[1]) THEN 'non_finite' WHEN v[1] = 0 AND list_max(v) = 0 AND list_min(v) = 0 THEN 'zero_vector' END AS why FROM e),
b AS (SELECT batch, count(*) AS n, arg_min(why, index) FILTER (why IS NOT NULL) AS why FROM r GROUP BY batch),
f AS (SELECT batch, CASE WHEN batch % 50 = 9 THEN 'count_mismatch' ELSE why END AS failure FROM b)
SELECT f.batch, failure, CASE WHEN failure IS NULL THEN count(*) END AS vectors, CASE WHEN failure IS NULL THEN round(sum((index + 1) * v[1] / sqrt(list_dot_product(v, v))), 6) END AS digest FROM f JOIN r USING (batch) GROUP BY f.batch, failure""")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as answers to batches of eight, some of them broken; the digest weighs first components by their place."""
    i = F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    each = lambda x: F.transform(v, lambda _: F.lit(x))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(i / 8).alias("batch"), (i % 8).alias("index"), F.when(i % 97 == 3, F.slice(v, 1, 10)).when(i % 89 == 5, each(0.0)).when(i % 83 == 7, each(float("inf"))).otherwise(v).alias("embedding"))
    expected = rows.groupBy("batch").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.when(F.col("batch") % 50 == 9, 1).otherwise(0))
    out = theme.embedding_batches(rows, expected, 64)
    digest = F.aggregate(F.transform("vectors", lambda u, n: (n + 1) * u[0]), F.lit(0.0), lambda a, x: a + x)
    return out.select("batch", "failure", F.when(F.col("failure").isNull(), F.size("vectors")).cast("long").alias("vectors"), F.round(digest, 6).alias("digest"))


JUDGED = """r AS (SELECT round(least(value, 100) / 100, 3) AS score, CASE WHEN event_id % 9 = 4 THEN 'uncertain' WHEN value >= 30 AND event_id % 20 <> 0 THEN 'relevant' WHEN event_id % 50 = 1 THEN 'relevant' ELSE 'off_theme' END AS label FROM events),
c AS (SELECT score FROM r UNION SELECT 0 UNION SELECT 1),
n AS (SELECT c.score, count(label) AS n, count_if(label = 'relevant') AS yes, count_if(label = 'off_theme') AS no FROM c LEFT JOIN r USING (score) GROUP BY 1),
s AS (SELECT score, sum(n) OVER up AS n, sum(yes) OVER up AS above, sum(yes) OVER down AS below, sum(no) OVER down AS off, sum(yes) OVER () AS every FROM n WINDOW up AS (ORDER BY score DESC), down AS (ORDER BY score)),
t AS (SELECT round(coalesce((SELECT score FROM s WHERE CASE WHEN every > 0 THEN below / every ELSE 0 END <= 0.02 ORDER BY off DESC, score LIMIT 1), 0), 8) AS exclude_max,
  round(coalesce((SELECT score FROM s WHERE CASE WHEN n > 0 THEN above / n ELSE 0 END >= 0.9 ORDER BY above DESC, score LIMIT 1), 1), 8) AS keep_min)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    label = F.when(i % 9 == 4, "uncertain").when((v >= 30) & (i % 20 != 0), "relevant").when(i % 50 == 1, "relevant").otherwise("off_theme")
    return table(spark, sf_dir, "events").select(F.round(F.least(v, F.lit(100.0)) / 100, 3).alias("score"), label.alias("label"))


@query(f"WITH {JUDGED} SELECT * FROM t")
def relevance_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.relevance_thresholds(judged(spark, sf_dir), "score", "label")


@query(f"""WITH {JUDGED} SELECT count_if(score >= keep_min AND label = 'relevant') / count_if(score >= keep_min) AS candidate_precision, count_if(score >= keep_min AND label = 'relevant') / count_if(label = 'relevant') AS relevant_recall,
  count_if(score <= exclude_max AND label = 'relevant') / count_if(label = 'relevant') AS false_exclusion_rate, count_if(score > exclude_max AND score < keep_min) / count(*) AS review_rate FROM r, t""")
def relevance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    return evaluation.relevance_metrics(rows, "score", "label", evaluation.relevance_thresholds(rows, "score", "label"))


@query(f"""WITH {PHOTOS}, p AS (SELECT album_id, count_if(decision IS NULL AND suggestion IN ('review', 'remove')) AS pending FROM photos GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN 'cleaning_not_completed' WHEN coalesce(pending, 0) > 0 THEN 'cleaning_review_pending' END AS refusal,
  'theme-analysis:' || c_custkey || ':' || (c_custkey % 7) || ':v1:' || left(sha256(CASE WHEN trim(c_mktsegment) = 'MACHINERY' THEN 'default' ELSE left(trim(c_mktsegment || ' ' || repeat(c_name, 40)), 500) END), 12) AS key
FROM customer LEFT JOIN p ON album_id = c_custkey""")
def theme_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = photos(spark, sf_dir).groupBy(F.col("album_id").alias("c_custkey")).agg(F.count_if(decisions.pending(F.col("decision"), F.col("suggestion"))).alias("pending"))
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "draft").when(k % 5 == 1, "uploaded").otherwise("cleaned")
    custom = F.when(F.trim("c_mktsegment") == "MACHINERY", "  ").otherwise(F.concat("c_mktsegment", F.lit(" "), F.repeat("c_name", 40)))
    rows = table(spark, sf_dir, "customer").join(pending, "c_custkey", "left")
    return rows.select("c_custkey", decisions.analysis_refusal(status, F.col("pending")).alias("refusal"), decisions.analysis_key(text_of("c_custkey"), (k % 7).cast("string"), "v1", custom).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus <> 'F' THEN 'not_available' WHEN o_orderkey % 3 = 0 THEN 'reopen' WHEN o_orderkey % 2 = 0 THEN 'reopen_and_clear' ELSE 'confirmation_needed' END AS outcome FROM orders""")
def theme_reopenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "review_pending").when(F.col("o_orderstatus") == "F", "confirmed")
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.reopening(status, k % 3, k % 2 == 0).alias("outcome"))


@query("""WITH g AS (SELECT DISTINCT user_id AS album_id, event_type AS title FROM events), e AS (SELECT album_id, 0 AS source, title AS nth, title FROM g UNION ALL SELECT album_id, 1, name, name FROM (SELECT DISTINCT album_id FROM g), (SELECT ' ' || upper(event_type) AS name FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT r_name FROM region)),
f AS (SELECT *, row_number() OVER (PARTITION BY album_id, lower(trim(title)) ORDER BY source, nth) AS seen FROM e), n AS (SELECT album_id, row_number() OVER (PARTITION BY album_id ORDER BY source, nth) AS nth, trim(title) AS title FROM f WHERE seen = 1) SELECT * FROM n WHERE nth <= 3""")
def theme_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "events").select(F.col("user_id").alias("album_id"), F.col("event_type").alias("title")).distinct()
    kinds = given.select(F.concat(F.lit(" "), F.upper("title")).alias("title")).distinct()
    presets = kinds.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("title")))
    nth = lambda df: df.withColumn("nth", F.col("title"))
    return theme.merged_candidates(nth(given), nth(presets)).withColumn("nth", F.col("nth").cast("long"))


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'candidates_ready' WHEN 'F' THEN 'confirmed' END AS status, o_orderkey % 3 AS analysed, o_orderkey % 2 AS confirmed, o_orderkey % 4 AS album FROM orders)
SELECT o_orderkey, CASE WHEN status IS NULL OR (analysed <> album AND status <> 'confirmed') THEN 'needs_analysis' WHEN status = 'candidates_ready' THEN 'choose_theme' WHEN confirmed = album THEN 'ready_to_cluster' ELSE 'needs_analysis' END AS phase FROM p""")
def workspace_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "candidates_ready").when(F.col("o_orderstatus") == "F", "confirmed")
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.workspace_phase(status, k % 3, k % 2, k % 4).alias("phase"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') AND o_orderkey % 3 > 0 THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'candidates_ready' WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'draft' END AS status FROM orders""")
def superseded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "candidates_ready").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status"))
    return lifecycle.superseded_but(rows, F.col("o_orderkey") % 3 == 0)


# ---- views, names and settings ----


@query("SELECT page_id, left(coalesce(html, ''), 800) AS snippet, coalesce(html, '') <> '' AS available FROM pages")
def page_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", texts.snippet(html).alias("snippet"), (F.coalesce(html, F.lit("")) != "").alias("available"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS taken_at, '{"sharpness":' || event_id % 10 || ',"faces":[{"id":1,"kind":"' || event_type || '"},{"id":2,"kind":"x"}]}' AS features FROM events""")
def photo_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array(F.lit(0.5)).alias("expression_vector")
    face = lambda n, kind: F.struct(F.lit(n).alias("id"), vector, kind.alias("kind"))
    features = F.struct(F.array(F.lit(0.1)).alias("color_histogram"), (F.col("event_id") % 10).alias("sharpness"), F.array(face(1, F.col("event_type")), face(2, F.lit("x"))).alias("faces"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", features.alias("features"))
    return rows.select("event_id", texts.iso(F.col("ts")).alias("taken_at"), F.to_json(structures.without(F.col("features"), ("color_histogram",), "faces", ("expression_vector",))).alias("features"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' 山 x' WHEN 1 THEN ' 春天的旅行 to 上海 ' || source ELSE '海边一家人的夏天与秋天的记忆' END, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) >= 2 THEN left(t, 8) END AS title FROM t""")
def cjk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.when(i % 3 == 0, " 山 x").when(i % 3 == 1, F.concat(F.lit(" 春天的旅行 to 上海 "), "source")).otherwise("海边一家人的夏天与秋天的记忆")
    return table(spark, sf_dir, "documents").select("doc_id", texts.cjk_title(F.concat(F.coalesce("text", F.lit("")), tail)).alias("title"))


@query("""WITH r AS (SELECT p_partkey, p_size % 5 AS k, CASE p_size % 5 WHEN 0 THEN '  ' WHEN 1 THEN p_name WHEN 2 THEN ' a, ' || p_brand || ' ,, b' WHEN 3 THEN ' ["' || p_type || '","x, y"]' END AS raw FROM part)
SELECT p_partkey, array_to_string(CASE k WHEN 3 THEN from_json(trim(raw), '["VARCHAR"]') ELSE list_filter(list_transform(string_split(coalesce(raw, ''), ','), lambda x: trim(x)), lambda x: x <> '') END, '|') AS items FROM r""")
def list_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    raw = F.when(k == 0, "  ").when(k == 1, F.col("p_name")).when(k == 2, F.concat(F.lit(" a, "), "p_brand", F.lit(" ,, b"))).when(k == 3, F.concat(F.lit(' ["'), "p_type", F.lit('","x, y"]')))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(structures.listed(raw), "|").alias("items"))


@query("""SELECT p_partkey, array_to_string(list_filter([lower(p_brand), lower(trim(p_name)), lower(p_type)], lambda x: x <> ''), '|') AS concepts FROM part""")
def theme_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.concat(F.lit(" "), F.upper("p_brand")), F.lit(" "), F.col("p_name"), F.lower("p_brand"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(structures.concepts(given), "|").alias("concepts"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN coalesce(nullif(trim(o_orderstatus), ''), '') ELSE o_orderpriority || ' again' END AS name FROM orders""")
def chapter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after a date, dates alone, which take the fallback, and plain names."""
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("2024年5月1日 · "), "o_orderpriority")).when(k % 3 == 1, "2024-05-01").otherwise(F.concat("o_orderpriority", F.lit(" again")))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.chapter_name(name, F.col("o_orderstatus")).alias("name"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(left(trim(coalesce(text, '')), 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS caption FROM documents""")
def html_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.html_text(F.col("text"), 120).alias("caption"))


# ---- times and captured fields ----


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS taken FROM orders""")
def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 7 HOURS")
    text = F.lit("soon")
    for n, form in enumerate(("yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")):
        text = F.when(k % 5 == n, F.date_format(at, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.lenient(text), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 12 HOUR - INTERVAL 90 MINUTE * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END), '%Y-%m-%d %H:%M:%S') AS taken_at, round((o_orderkey % 90 + 30 / 60 + 36 / 3600) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END, 7) AS lat,
  CASE WHEN o_orderkey % 7 > 0 THEN round(o_orderkey % 180 + 15 / 60, 7) END AS lon, nullif(trim(o_orderpriority), '') AS device FROM orders""")
def captured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    exif = F.create_map(
        F.lit("DateTimeOriginal"), F.date_format("o_orderdate", "yyyy:MM:dd 12:00:00"), F.lit("OffsetTimeOriginal"), F.when(k % 2 == 0, "+01:30").otherwise("-01:30"), F.lit("GPSLatitude"), F.concat((k % 90).cast("string"), F.lit(",30,36")),
        F.lit("GPSLatitudeRef"), F.when(k % 3 == 0, "S").otherwise("N"), F.lit("GPSLongitude"), F.when(k % 7 > 0, F.concat((k % 180).cast("string"), F.lit(",15,0"))), F.lit("Model"), F.concat(F.lit(" "), "o_orderpriority"),
    )
    f = images.capture_fields(exif)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(f["taken_at"], "yyyy-MM-dd HH:mm:ss").alias("taken_at"), f["lat"].alias("lat"), f["lon"].alias("lon"), f["device"].alias("device"))


# ---- tasks, projects, files ----


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def listed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("album_id"), F.col("event_type").alias("task_type"), F.col("ts").alias("created_at"))
    return control.listed(tasks, kind="error").select(F.col("task_id").alias("event_id"), F.col("album_id").alias("user_id"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'error' AND (event_id % 3 = 0 OR ts <= TIMESTAMP '2024-01-15') ORDER BY ts, event_id LIMIT 100")
def due_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of an outbox."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "pending").otherwise("sent").alias("status"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("available_at"), F.col("ts").alias("created_at"))
    return control.due(rows, F.lit("2024-01-15").cast("timestamp_ntz")).select("id")


@query("SELECT s_suppkey AS old, count(l_suppkey) AS moved FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def reassigned_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("old"), F.col("s_nationkey").cast("long").alias("new"))
    return control.reassigned(table(spark, sf_dir, "lineitem"), "l_suppkey", moves)[1]


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = c_custkey % 3) AS accepted FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def revision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    changes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("album"), F.when(k % 5 > 0, k % 3).alias("expected"))
    return control.fresh(changes, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album"), (F.col("c_custkey") % 3).alias("revision")), "album").select("o_orderkey", "accepted")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 4 = 0 OR o_custkey % 20 = o_orderkey % 20")
def accessible_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.where(decisions.accessible(k % 20, k % 10 == 0, F.when(k % 4 > 0, F.col("o_custkey") % 20))).select("o_orderkey")


@query(f"WITH {PHOTOS}, n AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY uploaded_at DESC, photo_id) AS n FROM photos) SELECT album_id, photo_id FROM n WHERE n <= 48")
def shown_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.shown(photos(spark, sf_dir), ["album_id"], [F.desc("uploaded_at"), F.asc("photo_id")], clicks=1).select("album_id", "photo_id")


@query("SELECT o_orderkey, o_orderkey % 7 >= 3 AND o_custkey % 2 = 0 AS valid FROM orders")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.struct((F.col("o_orderkey") % 7).alias("exp"), (F.col("o_custkey") % 2).alias("sub"))
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.token_valid(token, F.lit(3), sub=F.lit(0).cast("long")).alias("valid"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("""WITH c AS (SELECT vec_id % 500 AS photo_id, 'v' || (vec_id % 3) AS version, vec_id, embedding FROM embeddings), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY photo_id, version ORDER BY vec_id // 7 DESC, vec_id DESC) = 1)
SELECT w.vec_id AS photo_id, l.vec_id IS NOT NULL AS cached, round(l.embedding[1]::DOUBLE, 6) AS first FROM embeddings w LEFT JOIN l ON l.photo_id = w.vec_id AND l.version = 'v1'""")
def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    same = {"sha": F.lit("s"), "provider": F.lit("p"), "model": F.lit("m"), "dimension": F.lit(64)}
    cache = rows.withColumns(same | {"photo_id": i % 500, "feature_version": F.concat(F.lit("v"), (i % 3).cast("string")), "updated_at": F.floor(i / 7), "id": i})
    wanted = rows.select(i.alias("photo_id")).withColumns(same | {"feature_version": F.lit("v1")})
    return tables.cached(wanted, cache).select("photo_id", F.col("embedding").isNotNull().alias("cached"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("""SELECT sha256(coalesce(text, '')) AS key, min('d/' || doc_id) AS path FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en') GROUP BY 1""")
def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return tables.copied(docs.select("key", F.concat(F.lit("d/"), text_of("doc_id")).alias("path")), docs.where("lang = 'en'").select("key")).select("key", "path")


@query("""SELECT 'm' || doc_id AS name, 'missing' AS state FROM documents WHERE doc_id % 10 = 5
UNION ALL SELECT doc_id::VARCHAR, CASE doc_id % 10 WHEN 3 THEN 'unlisted' WHEN 5 THEN 'unlisted' WHEN 4 THEN 'mismatch' ELSE 'ok' END FROM documents""")
def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    content = F.coalesce("text", F.lit(""))
    listed = docs.where(i % 10 != 3).select(F.when(i % 10 == 5, F.concat(F.lit("m"), i.cast("string"))).otherwise(i.cast("string")).alias("name"), F.upper(F.sha2(F.when(i % 10 == 4, F.concat(content, F.lit("!"))).otherwise(content), 256)).alias("sha256"))
    return manifests.verified(docs.select(i.cast("string").alias("name"), content.alias("content")), listed)


# ---- evaluation ----


@query("""SELECT event_id, round(CASE WHEN value <= 5 THEN 0.1 WHEN value <= 20 THEN 0.1 + (0.6 - 0.1) * (value - 5) / 15 WHEN value <= 60 THEN 0.6 + (0.9 - 0.6) * (value - 20) / 40 ELSE 0.9 END, 6) AS probability FROM events""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.interpolated(F.col("value"), [5.0, 20.0, 60.0], [0.1, 0.6, 0.9]), 6).alias("probability"))


@query("""WITH c AS (SELECT count_if(event_type = 'view' AND value > 5) AS h1, count_if(event_type = 'view') AS n1, count_if(event_type = 'error' AND value > 90) AS h2, count_if(event_type = 'error') AS n2 FROM events), r AS (
  SELECT 'removal_precision' AS measure, h1 AS h, n1 AS n FROM c UNION ALL SELECT 'false_removal_rate', h2, n2 FROM c UNION ALL SELECT 'ungated', h2, n1 FROM c), w AS (
  SELECT measure, CASE WHEN n > 0 THEN h / n ELSE 0 END AS rate, least(1, ((h / n + 1.9208 / n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) AS high FROM r)
SELECT measure, round(rate, 9) AS rate, CASE measure WHEN 'removal_precision' THEN rate >= 0.995 WHEN 'false_removal_rate' THEN rate <= 0.005 AND high <= 0.005 ELSE true END AS passed FROM w""")
def cleaning_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    n = table(spark, sf_dir, "events").agg(F.count_if((kind == "view") & (v > 5)).alias("h1"), F.count_if(kind == "view").alias("n1"), F.count_if((kind == "error") & (v > 90)).alias("h2"), F.count_if(kind == "error").alias("n2"))
    row = lambda m, h, c: F.struct(F.lit(m).alias("measure"), F.col(h).alias("hits"), F.col(c).alias("cases"))
    long = n.select(F.explode(F.array(row("removal_precision", "h1", "n1"), row("false_removal_rate", "h2", "n2"), row("ungated", "h2", "n1"))).alias("r")).select("r.*")
    high = scoring.wilson(F.col("hits"), F.col("cases"))[1]
    measured = long.select("measure", scoring.ratio(F.col("hits"), F.col("cases")).alias("rate"), high.alias("high"))
    return evaluation.gates(measured).withColumn("rate", F.round("rate", 9))


@query("""WITH t AS (SELECT l_orderkey AS cluster, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS photo_id, l_discount < 0.06 AS acceptable, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
p AS (SELECT l_orderkey AS g, min(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS preferred, count_if(NOT (l_orderkey % 5 = 0 AND l_linenumber = 2)) AS m FROM lineitem GROUP BY 1),
c AS (SELECT cluster, bool_or(acceptable) AS good, max(n) AS n FROM t GROUP BY 1 HAVING max(n) >= 2)
SELECT count(*) AS groups, count_if(m = n AND EXISTS (SELECT 1 FROM t WHERE t.cluster = c.cluster AND t.photo_id = p.preferred AND acceptable)) AS right FROM c JOIN p ON g = cluster WHERE good""")
def preferred_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups of line items; every fifth predicted group lacks its second member."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("photo_id"), (F.col("l_discount") < 0.06).alias("acceptable"), "l_linenumber")
    first = rows.groupBy("cluster").agg(F.min("photo_id").alias("preferred"))
    predicted = rows.where(~((F.col("cluster") % 5 == 0) & (F.col("l_linenumber") == 2))).join(first, "cluster").select(F.col("cluster").alias("group_id"), "photo_id", "preferred")
    return evaluation.preferred_accuracy(predicted, rows.select("cluster", "photo_id", "acceptable"))


@query("""WITH m AS (SELECT l_orderkey, concat_ws(':', l_linenumber, l_partkey, l_suppkey) AS id, l_discount::DOUBLE * 10 AS a, l_tax::DOUBLE * 10 AS b FROM lineitem), g AS (SELECT l_orderkey, median(a) AS ma, median(b) AS mb FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT l_orderkey AS album_id, id AS photo_id, round((abs(a - ma) + abs(b - mb)) / 2, 6) AS deviation FROM m JOIN g USING (l_orderkey) WHERE round((abs(a - ma) + abs(b - mb)) / 2, 6) >= 0.35""")
def expression_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    expression = F.create_map(F.lit("smile"), F.col("l_discount").cast("double") * 10, F.lit("brow"), F.col("l_tax").cast("double") * 10)
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.lit(1).alias("group_id"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("photo_id"), expression.alias("expression"))
    return images.expression_outliers(members).select("album_id", "photo_id", "deviation")


@query("""WITH r AS (SELECT floor(least(value, 100)) / 100 AS signal, CASE WHEN event_id % 100 < least(value, 90) THEN 1.0 ELSE 0.0 END AS label FROM events), n AS (
  SELECT signal, count(*) AS n, sum(label) AS s FROM r GROUP BY 1), c AS (SELECT signal, n, s, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM n WINDOW w AS (ORDER BY signal)),
p AS (SELECT a.signal AS low, b.signal AS high, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.signal <= b.signal),
m AS (SELECT x.signal, p.low, min(p.mean) AS least FROM n x JOIN p ON p.low <= x.signal AND p.high >= x.signal GROUP BY ALL)
SELECT signal, round(round(max(least), 8), 6) AS probability FROM m GROUP BY signal""")
def isotonic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's level in the isotonic fit; the SQL takes the largest over beginnings of the smallest mean over ends."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select((F.floor(F.least(v, F.lit(100.0))) / 100).alias("signal"), F.when(F.col("event_id") % 100 < F.least(v, F.lit(90.0)), 1.0).otherwise(0.0).alias("label"))
    xs, ys = evaluation.isotonic(rows, "signal", "label")
    return rows.select("signal").distinct().select("signal", F.round(scoring.interpolated(F.col("signal"), xs, ys), 6).alias("probability"))


# ---- books and pictures ----


@query(f"""{'WITH ' + PAGED}, s2 AS (SELECT s.*, p.chapter FROM sections s JOIN (SELECT album_id, page, min(chapter) AS chapter FROM paged GROUP BY ALL) p USING (album_id, page)),
ch AS (SELECT album_id, chapter, count(*) AS photos FROM placed GROUP BY ALL), f AS (SELECT album_id, chapter, min(page) AS first, count(*) AS pages FROM s2 GROUP BY ALL),
d AS (SELECT f.*, photos, row_number() OVER (PARTITION BY f.album_id ORDER BY first) AS nth FROM f JOIN ch ON f.album_id = ch.album_id AND f.chapter = ch.chapter),
a AS (SELECT album_id, count(*) AS photo_count FROM placed GROUP BY 1), z AS (SELECT album_id, count(*) AS chapters FROM ch GROUP BY 1), y AS (SELECT album_id, count(*) AS pages FROM s2 GROUP BY 1),
w AS (SELECT *, 'Album ' || album_id AS title, CASE WHEN album_id % 2 = 0 THEN 'A <' || album_id || '>' END AS cover_title FROM a JOIN z USING (album_id) JOIN y USING (album_id)),
parts AS (SELECT album_id, page, 1 AS kind, html FROM s2
  UNION ALL SELECT album_id, first, 0, '<section class="divider"><p class="kicker">Chapter ' || lpad(nth::VARCHAR, 2, '0') || '</p><h2>' || chapter || '</h2><p class="description">all of ' || chapter || '</p><p class="counts">' || photos || ' Photos, ' || pages || ' Pages</p></section>' FROM d
  UNION ALL SELECT album_id, -1, 0, '<section class="cover"><h1>' || CASE WHEN cover_title IS NULL THEN title ELSE 'A &lt;' || album_id || '&gt;' END || '</h1>' || CASE WHEN cover_title IS NULL THEN '' ELSE '<p class="subtitle">' || title || '</p>' END || '<p class="counts">' || photo_count || ' Photos, ' || chapters || ' Chapters</p><p class="style">minimal</p></section>' FROM w
  UNION ALL SELECT album_id, 1099511627776, 2, '<section class="closer"><h2>' || title || '</h2><p class="counts">' || photo_count || ' Photos, ' || chapters || ' Chapters, ' || pages || ' Pages</p></section>' FROM w)
SELECT album_id, sha256('<!doctype html><title>Album ' || album_id || '</title>' || string_agg(html, '' ORDER BY page, kind)) AS html_sha256, sum(length(html))::BIGINT AS chars FROM parts GROUP BY album_id""")
def full_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir).withColumn("caption", F.concat("device", F.lit(" & <"), text_of("photo_id"), F.lit(">")))
    of = rows.groupBy("album_id", "page").agg(F.min("chapter").alias("chapter"))
    sections = layout.markup(rows, layout.templates(rows), "caption").join(of, ["album_id", "page"])
    chapters = rows.groupBy("album_id", "chapter").agg(F.count("*").alias("photos")).withColumns({"name": F.col("chapter"), "description": F.concat(F.lit("all of "), "chapter")})
    albums = rows.groupBy("album_id").agg(F.count("*").alias("photo_count")).withColumns({
        "title": F.concat(F.lit("Album "), text_of("album_id")), "cover_title": F.when(F.col("album_id") % 2 == 0, F.concat(F.lit("A <"), text_of("album_id"), F.lit(">"))), "style": F.lit("minimal"),
    })
    head = F.length(F.concat(F.lit("<!doctype html><title></title>"), F.lit("Album "), text_of("album_id")))
    return layout.full_books(sections, chapters, albums).select("album_id", F.sha2("html", 256).alias("html_sha256"), (F.length("html") - head).cast("long").alias("chars"))


EDGE = 24
#: A picture of EDGE x EDGE gray pixels for each part, as a formula of place and key.
PIXEL = "(({k} % 7 + 1) * {x} * 5 + ({k} % 11) * {y} * 3 + ({k} % 5) * {x} * {y}) % 256"


@query(f"""WITH p AS (SELECT p_partkey, x, y, ({PIXEL.format(k="p_partkey", x="x", y="y")})::DOUBLE AS g FROM part, range({EDGE}) a(x), range({EDGE}) b(y)),
n AS (SELECT *, lag(g) OVER r AS l, lead(g) OVER r AS m, lag(g) OVER c AS u, lead(g) OVER c AS d FROM p WINDOW r AS (PARTITION BY p_partkey, y ORDER BY x), c AS (PARTITION BY p_partkey, x ORDER BY y)),
b AS (SELECT p_partkey, floor(g / 4) AS level, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT p_partkey, -sum(n / {EDGE * EDGE} * log2(n / {EDGE * EDGE})) AS entropy FROM b GROUP BY 1),
s AS (SELECT p_partkey, var_pop(l + m + u + d - 4 * g) AS laplacian, avg((g <= 2.55)::INT) AS dark, avg((g >= 252.45)::INT) AS bright, quantile_cont(g / 255, 0.05) AS p05, quantile_cont(g / 255, 0.5) AS p50, quantile_cont(g / 255, 0.95) AS p95 FROM n GROUP BY 1)
SELECT p_partkey, round(laplacian, 3) AS laplacian, round(entropy, 6) AS entropy, round(dark, 6) AS dark, round(bright, 6) AS bright, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM s JOIN e USING (p_partkey)""")
def picture_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    side, gray = F.sequence(F.lit(0), F.lit(EDGE - 1)), F.array(*(F.lit(f"{v:02x}" * 3) for v in range(256)))
    level = lambda x, y: (x * ((k % 7 + 1) * 5 + (k % 5) * y) + (k % 11) * y * 3) % 256
    pixels = F.unhex(F.array_join(F.flatten(F.transform(side, lambda y: F.transform(side, lambda x: F.element_at(gray, (level(x, y) + 1).cast("int"))))), ""))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.lit(EDGE).alias("width"), F.lit(EDGE).alias("height"), pixels.alias("pixels"))
    m = lambda name: F.round(F.col("m")[name], 6)
    out = images.measured(rows, "p_partkey")
    return out.select(F.col("key").alias("p_partkey"), F.round(F.col("m")["a_laplacian"], 3).alias("laplacian"), m("a_entropy").alias("entropy"), *(m(n).alias(n) for n in ("dark", "bright", "p05", "p50", "p95")))


REQUESTS = """e AS (
  SELECT user_id AS k, ts AS tm, event_type IN ('error', 'signup') AS is_end, 't' || CASE WHEN event_type IN ('error', 'signup') THEN coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) ELSE event_id END AS task,
    'i' || (event_id % 5) AS idem, event_id % 6 > 0 AS holds FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm, is_end DESC, task) AS n FROM e),
r AS (
  SELECT DISTINCT k, 0::BIGINT AS n, []::STRUCT(task VARCHAR, idem VARCHAR, holds BOOLEAN, since TIMESTAMP)[] AS active, NULL::VARCHAR AS task, NULL::VARCHAR AS decision, NULL::VARCHAR AS meant, NULL::TIMESTAMP AS tm FROM o
  UNION ALL
  SELECT k, n, CASE WHEN is_end THEN list_filter(live, lambda a: a.task <> task) WHEN same IS NULL AND held IS NULL THEN list_append(live, struct_pack(task := task, idem := idem, holds := holds, since := tm)) ELSE live END,
    task, CASE WHEN NOT is_end THEN CASE WHEN same IS NOT NULL THEN 'existing' WHEN held IS NOT NULL THEN 'conflict' ELSE 'created' END END, CASE WHEN NOT is_end THEN coalesce(same, held, task) END, tm
  FROM (SELECT *, list_filter(live, lambda a: a.idem = idem)[1]['task'] AS same, list_filter(live, lambda a: a.holds)[1]['task'] AS held
    FROM (SELECT p.k, p.n, p.tm, p.is_end, p.task, p.idem, p.holds, list_filter(r.active, lambda a: epoch_us(p.tm) - epoch_us(a.since) < 172800000000) AS live FROM r JOIN o p ON p.k = r.k AND p.n = r.n + 1)))"""


@query(f"""WITH RECURSIVE {REQUESTS} SELECT k AS album_id, task AS task_id, tm AS "at", decision, meant AS active FROM r WHERE decision IS NOT NULL""")
def task_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, ends = F.col("event_id"), F.col("event_type").isin("error", "signup")
    before = F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("album_id"), F.col("ts").cast("timestamp").alias("at"), F.when(ends, "end").otherwise("request").alias("kind"), name("t", F.when(ends, before).otherwise(i)).alias("task_id"), name("i", i % 5).alias("idempotency"), (i % 6 > 0).alias("holds"))
    return rules.task_requests(events, "album_id", 48 * 3600).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT conv_id AS chapter, conv_id * 100 + turn AS photo_id, turn AS place FROM conversations)
SELECT chapter - chapter % 6 AS chapter, photo_id, row_number() OVER (PARTITION BY chapter - chapter % 6 ORDER BY chapter % 6 > 0, chapter, place) - 1 AS place FROM c""")
def merged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters merged into the one before, five in a row."""
    now = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), (F.col("conv_id") * 100 + F.col("turn")).alias("photo_id"), F.col("turn").alias("place"))
    merges = now.where("chapter % 6 > 0").select(F.col("chapter").alias("source"), (F.col("chapter") - 1).alias("target")).distinct()
    return layout.merged(now, merges)


# ---- chapters, projects and artifacts ----


@query("""WITH c AS (SELECT conv_id AS chapter, conv_id * 100 + turn AS photo_id, turn AS place FROM conversations), r AS (
  SELECT CASE WHEN chapter % 3 = 1 THEN chapter - 1 ELSE chapter END AS t, chapter % 3 = 1 AS late, * FROM c)
SELECT t AS chapter, photo_id, row_number() OVER (PARTITION BY t ORDER BY late, chapter, place) - 1 AS place FROM r""")
def merged_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), (F.col("conv_id") * 100 + F.col("turn")).alias("photo_id"), F.col("turn").alias("place"))
    merges = now.where("chapter % 3 < 2").select(F.col("chapter").alias("source"), (F.col("chapter") - F.col("chapter") % 3).alias("target")).distinct()
    return layout.merged(now, merges)


@query("""SELECT o_orderkey AS chapter, CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'auto' END AS source, CASE WHEN o_orderstatus <> 'F' THEN 'v3' END AS version, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 10 END AS quality,
  o_orderstatus <> 'F' AND o_orderkey % 2 = 0 AS needs_review, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS explanation FROM orders""")
def edited_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    chapters = orders.select(k.alias("chapter"), F.lit("auto").alias("source"), F.lit("v3").alias("version"), (k % 10).alias("quality"), (k % 2 == 0).alias("needs_review"), F.col("o_orderpriority").alias("explanation"))
    return layout.edited(chapters, orders.where("o_orderstatus = 'F'").select(k.alias("chapter")))


@query("""SELECT c_custkey, CASE WHEN active > 0 THEN 'running_tasks' WHEN n > 0 AND c_custkey % 4 > 0 THEN 'contains_albums' END AS refusal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'P') AS active FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def project_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("active"))
    return table(spark, sf_dir, "customer").join(by, "c_custkey", "left").select("c_custkey", decisions.deletion_refusal(F.col("active"), F.col("n"), F.col("c_custkey") % 4 == 0).alias("refusal"))


@query("""SELECT DISTINCT s_nationkey::BIGINT AS project FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R')""")
def busy_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "O", "queued").when(F.col("l_returnflag") == "R", "running").otherwise("succeeded")
    tasks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("album_id"), status.alias("status"))
    albums = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("album_id"), F.col("s_nationkey").cast("long").alias("project"))
    return lifecycle.busy(tasks, albums, "project")


@query("""WITH a AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'rendered' WHEN 1 THEN 'exported' ELSE 'planned' END AS status, p_brand LIKE '%1' AS hit FROM part)
SELECT p_partkey, CASE WHEN hit AND status <> 'planned' THEN 'cleaned' ELSE status END AS status, NOT hit AS has_preview, CASE WHEN hit THEN 2 ELSE 0 END AS deleted FROM a""")
def cleared_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    s = F.col("p_size") % 3
    path = lambda kind: F.concat(F.lit(f"{kind}/"), text_of("p_partkey"))
    albums = part.select("p_partkey", F.when(s == 0, "rendered").when(s == 1, "exported").otherwise("planned").alias("status"), path("preview").alias("preview_path"), path("print").alias("print_path"), F.lit(None).cast("string").alias("manifest_path"))
    after, gone = lifecycle.cleared(albums, part.where("p_brand LIKE '%1'"), "p_partkey")
    n = gone.groupBy("p_partkey").agg(F.count("*").alias("deleted"))
    return after.join(n, "p_partkey", "left").select("p_partkey", "status", F.col("preview_path").isNotNull().alias("has_preview"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


@query(f"WITH {PHOTOS} SELECT album_id, photo_id, row_number() OVER (PARTITION BY album_id ORDER BY uploaded_at, photo_id) - 1 AS position FROM photos")
def photo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.positions(photos(spark, sf_dir)).select("album_id", "photo_id", "position")


@query(f"WITH {PHOTOS}, n AS (SELECT album_id, photo_id, row_number() OVER (PARTITION BY album_id ORDER BY quality DESC, photo_id) AS nth FROM photos) SELECT * FROM n WHERE nth <= 6")
def theme_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.best_rated(photos(spark, sf_dir)).select("album_id", "photo_id", "nth")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 3 = 0 WHEN 1 THEN o_orderkey % 3 = 1 WHEN 2 THEN o_orderkey % 3 = 0 ELSE false END AS allowed FROM orders")
def allowed_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 0, "chapter").when(k % 4 == 1, "chapter_embedding").when(k % 4 == 2, "layout").otherwise("cleaning")
    provider = F.when(k % 3 == 0, "openai_compatible").when(k % 3 == 1, "dashscope_multimodal_embedding")
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.provider_allowed(stage, provider).alias("allowed"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'own' END AS include, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS exclude FROM part""")
def settled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    none = F.lit(None).cast("array<string>")
    held = F.struct(F.when(n % 2 == 1, F.array(F.lit("own"))).alias("include_concepts"), none.alias("exclude_concepts"))
    one = F.struct(F.lit("c1").alias("id"), F.col("p_name").alias("title"), F.lit("s").alias("summary"), F.array("p_type").alias("include_concepts"), F.when(n % 3 == 0, F.array("p_brand")).alias("exclude_concepts"), held.alias("constraints"))
    c = structures.settled_candidates(F.array(one))[0]["constraints"]
    text = lambda k: F.coalesce(F.array_join(c[k], ","), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", text("include_concepts").alias("include"), text("exclude_concepts").alias("exclude"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'a,b,F,' || o_orderpriority ELSE 'a,b,' || o_orderpriority END AS reasons FROM orders""")
def joined_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("b"), F.col("o_orderstatus"), F.lit("a")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(structures.joined(F.array(F.lit("a"), F.lit("b"), F.lit("a")), more, F.array("o_orderpriority")), ",").alias("reasons"))


@query("SELECT vec_id % 20 AS album_id, count(*) AS photos, count_if(label % 2 = 0)::BIGINT AS embedded FROM embeddings GROUP BY 1")
def feature_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("album_id"), F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("embedding"))
    return theme.feature_summary(rows, "album_id")


@query("""WITH r AS (SELECT l_suppkey AS album_id, l_orderkey % 12 AS chapter, l_linenumber AS segment, l_orderkey % 12 < 5 AND l_quantity < 3 AS r, l_linenumber > 4 AND l_tax > 0.07 AS s FROM lineitem),
g AS (SELECT album_id, chapter, segment, bool_or(r) AS r, bool_or(s) AS s FROM r GROUP BY ALL)
SELECT album_id, count(DISTINCT chapter) AS chapters, count(DISTINCT CASE WHEN r THEN chapter END) AS review_chapters, count(*) AS segments, count_if(s)::BIGINT AS review_segments FROM g GROUP BY 1""")
def chapter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as photos of a supplier's album."""
    chapter = F.col("l_orderkey") % 12
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("album_id"), chapter.alias("chapter"), F.col("l_linenumber").alias("segment"), ((chapter < 5) & (F.col("l_quantity") < 3)).alias("needs_review"), ((F.col("l_linenumber") > 4) & (F.col("l_tax") > 0.07)).alias("segment_needs_review"))
    return timeline.chapter_counters(rows)


# ---- media ----

SIZED = "f AS (SELECT p_partkey, p_partkey * 37 % 20000 + 1 AS w, p_partkey * 91 % 16000 + 1 AS h, p_partkey % 5 AS kind, p_partkey // 250 AS batch FROM part)"


@query(f"""WITH {SIZED}, o AS (SELECT *, CASE WHEN kind = 4 THEN 'unsupported_type' WHEN w * h > 60000000 THEN 'too_many_pixels' END AS own FROM f),
c AS (SELECT *, count_if(own IS NULL) OVER (PARTITION BY batch ORDER BY p_partkey) AS n FROM o)
SELECT p_partkey, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN w ELSE h END AS height, coalesce(own, CASE WHEN n > 200 THEN 'too_many_files' END) AS reason FROM c""")
def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG, bitmaps stored from the top, WEBP and JPEG files, made from keys, and what an upload of 250 files in a batch accepts."""
    k = F.col("p_partkey")
    w, h, kind = k * 37 % 20000 + 1, k * 91 % 16000 + 1, k % 5
    big = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    little = lambda n, size: F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4))
    bmp = F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(F.lit(1 << 32) - h, 4))
    webp = F.concat(F.lit("524946460000000057454250565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3))
    jpeg = F.concat(F.lit("FFD8FFE1000401"), F.lit("02FFC0001108"), big(h, 2), big(w, 2), F.lit("00" * 10))
    content = F.unhex(F.when(kind == 0, png).when(kind == 1, bmp).when(kind == 2, webp).otherwise(jpeg))
    suffix = F.when(kind == 0, ".png").when(kind == 1, ".bmp").when(kind == 2, ".webp").when(kind == 3, ".JPG").otherwise(".tiff")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lpad(text_of("p_partkey"), 9, "0"), suffix).alias("path"), content.alias("content"), F.floor(k / 250).alias("batch"))
    out = media.checked(media.with_sizes(rows.withColumn("length", F.length("content"))), "batch")
    size = media.upright(F.col("width"), F.col("height"), k % 9)
    return out.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), "reason")
