"""Queries on layout, evaluation, tables of tasks and settings, texts, and rules over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import decisions, markup, scoring, texts
from darkroom.operators import control, evaluation, layout
from darkroom.plans.analogs import PHOTOS, photos, table
from darkroom.streaming import rules

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAGED = f"""{PHOTOS}, placed AS (SELECT *, device AS chapter, row_number() OVER (PARTITION BY album_id, device ORDER BY uploaded_at, photo_id) - 1 AS n FROM photos), paged AS (
  SELECT *, n % 3 AS slot, dense_rank() OVER (PARTITION BY album_id ORDER BY chapter, n // 3) AS page FROM placed), counted AS (
  SELECT album_id, page, count(*) AS photos, count_if(height > width * 1.12) AS p, count_if(width > height * 1.12) AS l FROM paged GROUP BY ALL), styled AS (
  SELECT album_id, page, photos, CASE photos WHEN 1 THEN CASE WHEN l = 1 THEN 'cinema_landscape' WHEN p = 1 THEN 'gallery_portrait' ELSE 'full_page' END WHEN 2 THEN CASE WHEN p = 2 THEN 'half_half' WHEN l >= 1 THEN 'two_column' ELSE 'staggered_duo' END
    ELSE CASE WHEN p >= 2 THEN 'one_large_two_small' WHEN l >= 2 THEN 'triptych_strip' ELSE 'grid_3' END END AS template FROM counted), sections AS (
  SELECT s.album_id, s.page, '<section class="' || template || '">' || string_agg('<figure>' || replace(device || ' & <' || photo_id || '>', '&', '&amp;').replace('<', '&lt;').replace('>', '&gt;') || '</figure>', '' ORDER BY slot) || '</section>' AS html
  FROM styled s JOIN paged USING (album_id, page) GROUP BY s.album_id, s.page, template)"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages(photos(spark, sf_dir).withColumns({"chapter": F.col("device"), "place": F.col("uploaded_at"), "caption": F.concat("device", F.lit(" & <"), F.col("photo_id").cast("string"), F.lit(">"))}))


@query(f"WITH {PAGED} SELECT album_id, photo_id, page, slot FROM paged")
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("album_id", "photo_id", "page", "slot")


@query(f"WITH {PAGED} SELECT * FROM styled")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.templates(paged(spark, sf_dir))


@query(f"WITH {PAGED} SELECT album_id, '<!doctype html><title>Album ' || album_id || '</title>' || string_agg(html, '' ORDER BY page) AS html FROM sections GROUP BY album_id")
def album_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir)
    titles = rows.select("album_id").distinct().withColumn("title", F.concat(F.lit("Album "), F.col("album_id").cast("string")))
    return layout.books(layout.markup(rows, layout.templates(rows), "caption"), titles)


@query("""WITH c AS (SELECT conv_id AS chapter, conv_id * 100 + turn AS photo_id, turn AS place FROM conversations), m AS (SELECT (chapter + 1) % 50 AS chapter, photo_id, photo_id AS nth FROM c WHERE place = 1)
SELECT chapter, photo_id, row_number() OVER (PARTITION BY chapter ORDER BY late, nth, photo_id) - 1 AS place FROM (SELECT chapter, photo_id, 0 AS late, place AS nth FROM c WHERE place <> 1 UNION ALL SELECT chapter, photo_id, 1, nth FROM m)""")
def moved_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), (F.col("conv_id") * 100 + F.col("turn")).alias("photo_id"), F.col("turn").alias("place"))
    moves = now.where("place = 1").select(((F.col("chapter") + 1) % 50).alias("chapter"), "photo_id", F.col("photo_id").alias("nth"))
    return layout.moved(now, moves)


@query("""WITH p AS (SELECT DISTINCT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b FROM documents x JOIN documents y ON x.n_chars = y.n_chars AND x.lang = y.lang AND x.doc_id < y.doc_id),
t AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id), n AS (
SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS common, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM t) AS "true") SELECT *, common / predicted AS precision, common / "true" AS recall FROM n""")
def duplicate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", "lang", F.sha2("text", 256).alias("sha"))
    return evaluation.key_pair_scores(docs, ["n_chars", "lang"], ["sha"])




@query("""WITH s AS (SELECT conv_id, turn, turn // 2 <> lag(turn // 2) OVER w AS e, length(text) // 100 <> lag(length(text) // 100) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT conv_id, count_if(e)::BIGINT AS expected, count_if(p)::BIGINT AS predicted, count_if(e AND p)::BIGINT AS matched FROM s GROUP BY conv_id),
r AS (SELECT *, CASE WHEN predicted > 0 THEN matched / predicted ELSE (expected = 0)::INT::DOUBLE END AS precision, CASE WHEN expected > 0 THEN matched / expected ELSE (predicted = 0)::INT::DOUBLE END AS recall FROM n)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("expected_chapter"), F.floor(F.length("text") / 100).alias("predicted_chapter"))
    return evaluation.boundary_scores(rows, "conv_id", ["turn"], "expected_chapter", "predicted_chapter")


@query("""WITH c AS (SELECT lang AS e, source AS p, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
e AS (SELECT sum(m * (m - 1) / 2) AS pe, -sum(m / t * ln(m / t)) AS he, count(*) AS ke FROM (SELECT sum(n) AS m FROM c GROUP BY e), t), p AS (SELECT sum(m * (m - 1) / 2) AS pp, -sum(m / t * ln(m / t)) AS hp, count(*) AS kp FROM (SELECT sum(n) AS m FROM c GROUP BY p), t),
j AS (SELECT sum(n * (n - 1) / 2) AS pj, -sum(n / t * ln(n / t)) AS hj FROM c, t)
SELECT round((pj - pe * pp / (t * (t - 1) / 2)) / ((pe + pp) / 2 - pe * pp / (t * (t - 1) / 2)), 8) AS adjusted_rand, round((he + hp - hj) / ((he + hp) / 2), 8) AS normalized_mutual_info, kp / ke AS oversegmentation FROM j, e, p, t""")
def clustering_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.clustering_scores(table(spark, sf_dir, "documents"), "lang", "source")
    return out.select(F.round("adjusted_rand", 8).alias("adjusted_rand"), F.round("normalized_mutual_info", 8).alias("normalized_mutual_info"), "oversegmentation")


JUDGED = "judged AS (SELECT l.*, n_chars < 300 AS gone, n_chars FROM labels l JOIN documents USING (doc_id))"


@query(f"""WITH {JUDGED}, m AS (SELECT 'false_removal' AS measure, count_if(gone AND quality = 1)::BIGINT AS hits, count_if(quality = 1)::BIGINT AS cases FROM judged UNION ALL SELECT 'removal_precision', count_if(gone AND quality = 0), count_if(gone) FROM judged),
r AS (SELECT *, CASE WHEN cases > 0 THEN hits / cases ELSE 1.0 END AS rate FROM m)
SELECT *, round(CASE WHEN cases = 0 THEN 1.0 ELSE greatest(0.0, (rate + 3.8416 / (2 * cases)) / (1 + 3.8416 / cases) - 1.96 * sqrt(rate * (1 - rate) / cases + 3.8416 / (4 * cases * cases)) / (1 + 3.8416 / cases)) END, 8) AS low,
  round(CASE WHEN cases = 0 THEN 1.0 ELSE least(1.0, (rate + 3.8416 / (2 * cases)) / (1 + 3.8416 / cases) + 1.96 * sqrt(rate * (1 - rate) / cases + 3.8416 / (4 * cases * cases)) / (1 + 3.8416 / cases)) END, 8) AS high FROM r""")
def removal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    gone, good = F.col("n_chars") < 300, F.col("quality") == 1
    out = evaluation.rates(rows, {"removal_precision": (~good, gone), "false_removal": (gone, good)})
    return out.select("measure", "hits", "cases", "rate", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query(f"""WITH {JUDGED}, s AS (SELECT least(1.0, n_chars / 4000) AS score, quality FROM judged), t AS (SELECT DISTINCT score AS threshold FROM s), p AS (
  SELECT threshold, count(*) AS n, count_if(quality = 1) AS hit FROM t JOIN s ON score >= threshold GROUP BY threshold)
SELECT threshold, hit / n AS precision, hit / (SELECT count_if(quality = 1) FROM s) AS recall FROM p WHERE hit >= 0.8 * n ORDER BY hit DESC, threshold LIMIT 1""")
def keep_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.keep_threshold(rows.withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 4000)), "score", F.col("quality") == 1, 0.8)


@query("SELECT count(*) AS families, count_if(kinds = 1)::BIGINT AS consistent FROM (SELECT sha256(text), count(DISTINCT lang) AS kinds FROM documents GROUP BY 1 HAVING count(*) >= 2)")
def family_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.family_consistency(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("family"), "lang"), "family", "lang")


@query("""SELECT count(*) >= 500 AS enough_rows, count(DISTINCT event_type) >= 8 AS enough_categories, true AS one_configuration, bool_and(event_id % 97 <> 1) AS valid_labels, true AS two_annotators, false AS passed FROM events""")
def dataset_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dimension"), F.when(F.col("event_id") % 97 == 1, "odd").otherwise("relevant").alias("label"), F.array(F.lit("x"), F.lit("y")).alias("annotators")
    )
    return evaluation.requirements(rows)


@query("""SELECT n_nationkey, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("n_nationkey"))
    return control.child_counts(table(spark, sf_dir, "nation"), "n_nationkey", {"customers": of("customer", "c_nationkey"), "suppliers": of("supplier", "s_nationkey")})


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1")
def superseded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.superseded(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("event_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return control.upserted(stored, stored.where("id % 5 = 0").withColumn("status", F.lit("new")), ["id"])


@query("SELECT event_id AS task_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 600 SECONDS")
def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).otherwise(F.col("ts")).alias("heartbeat"))
    return control.stale(tasks, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("task_id")


@query("""WITH c AS (SELECT o_custkey % 200 AS task_id, o_orderkey AS worker, o_orderdate AS made FROM orders) SELECT task_id, worker FROM c WHERE task_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY made, worker) = 1""")
def claimed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("task_id"), F.col("o_orderkey").alias("worker"), F.col("o_orderdate").alias("at"))
    tasks = spark.range(200).select(F.col("id").alias("task_id"), F.when(F.col("id") % 3 == 0, "queued").otherwise("done").alias("status"))
    return control.claimed(tasks, claims)


@query("""WITH s AS (SELECT CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS project, CASE WHEN p_partkey % 2 = 0 THEN p_size % 10 END AS stage, p_size AS priority, p_name || p_partkey AS value FROM part),
w AS (SELECT DISTINCT p_brand AS project, p_size % 10 AS stage FROM part),
r AS (SELECT w.project, w.stage, s.value, row_number() OVER (PARTITION BY w.project, w.stage ORDER BY CASE WHEN s.project IS NOT NULL AND s.stage IS NOT NULL THEN 0 WHEN s.project IS NOT NULL THEN 1 WHEN s.stage IS NOT NULL THEN 2 ELSE 3 END, s.priority, s.value) AS n
  FROM w LEFT JOIN s ON (s.project IS NULL OR s.project = w.project) AND (s.stage IS NULL OR s.stage = w.stage)) SELECT project, stage, value FROM r WHERE n = 1""")
def setting_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    scopes = part.select(F.when(k % 4 < 2, F.col("p_brand")).alias("project"), F.when(k % 2 == 0, F.col("p_size") % 10).alias("stage"), F.col("p_size").alias("priority"), F.concat("p_name", k.cast("string")).alias("value"))
    return control.setting(scopes, part.select(F.col("p_brand").alias("project"), (F.col("p_size") % 10).alias("stage")).distinct())


@query("""WITH n AS (SELECT p_partkey AS name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part UNION ALL SELECT -1, 'brand'),
t AS (SELECT DISTINCT slug AS code FROM n WHERE slug LIKE '%1' UNION SELECT slug || '-3' FROM n WHERE slug LIKE '%1' UNION SELECT slug || '-2024' FROM n UNION SELECT 'brand' UNION SELECT 'brand-2'),
c AS (SELECT s.slug, i FROM (SELECT slug, count(*) AS k FROM n GROUP BY slug) s, unnest(range(1, k + 60)) u(i) WHERE CASE WHEN i = 1 THEN slug ELSE slug || '-' || i END NOT IN (SELECT code FROM t) AND (i = 1 OR slug || '-' || i NOT IN (SELECT slug FROM n))),
f AS (SELECT slug, i, row_number() OVER (PARTITION BY slug ORDER BY i) AS k FROM c), m AS (SELECT name, slug, row_number() OVER (PARTITION BY slug ORDER BY name) AS k FROM n)
SELECT name, CASE WHEN i = 1 THEN slug ELSE slug || '-' || i END AS code FROM m JOIN f USING (slug, k)""")
def next_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of parts by their brands' slugs, which end in numbers themselves, and of one name whose slug is the common beginning of all."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), texts.slugify(F.col("p_brand")).alias("slug"))
    names = names.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("name"), F.lit("brand").alias("slug")))
    ones = names.where("slug LIKE '%1'")
    taken = ones.select(F.explode(F.array(F.col("slug"), F.concat("slug", F.lit("-3")))).alias("code")).unionByName(names.select(F.concat("slug", F.lit("-2024")).alias("code")))
    return control.next_code(names, taken.unionByName(spark.range(1).select(F.explode(F.array(F.lit("brand"), F.lit("brand-2"))).alias("code"))))


@query("""WITH t AS (SELECT doc_id, 'trip ' || (1990 + doc_id % 40) || '至' || (1990 + doc_id % 53) || ', again ' || (2000 + doc_id % 7) || '年' || (doc_id % 12 + 1) || '月' || (doc_id % 28 + 1) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct([1990 + doc_id % 40, 1990 + doc_id % 53, 2000 + doc_id % 7] || CASE WHEN abs(doc_id % 53 - doc_id % 40) <= 20 THEN range(1990 + least(doc_id % 40, doc_id % 53), 1991 + greatest(doc_id % 40, doc_id % 53)) ELSE [] END)), ',') AS years,
  (2000 + doc_id % 7) || '-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS date FROM t""")
def requested_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    t = F.concat(F.lit("trip "), s(1990 + i % 40), F.lit("至"), s(1990 + i % 53), F.lit(", again "), s(2000 + i % 7), F.lit("年"), s(i % 12 + 1), F.lit("月"), s(i % 28 + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(texts.years(t)).cast("array<string>"), ",").alias("years"), texts.dates(t)[0].alias("date"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, left(trim(regexp_replace(p_name || ': <' || p_type || '>', '[<>:]', '_', 'g').replace(' ', '_'), '._'), 40) AS file, replace(p_name || ' & ' || p_type, '&', '&amp;') AS html FROM part""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(": <"), F.col("p_type"), F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.slugify(F.col("p_name")).alias("slug"), texts.safe_name(name).alias("file"), texts.escape_html(F.concat("p_name", F.lit(" & "), F.col("p_type"))).alias("html"))


@query("SELECT page_id, replace(html, '<a href=\"/The\"', '<a href=\"/r1/$The\"') AS html FROM pages")
def rewritten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.rewrite_attribute(F.col("html"), "a", "href", F.lit("/The"), F.lit("/r1/$The")).alias("html"))


@query("""WITH p AS (SELECT page_id, 'p' || page_id || '.png' AS k, '/r/' || page_id || '?a=1&amp;b=&quot;2' AS v FROM pages)
SELECT page_id, '<IMG SRC="' || v || '"><img alt=">" src="' || v || '"/><img' || chr(10) || 'data-src="' || k || '" src = "' || v || '"><!-- <img src="' || k || '"> --><script>"<img src=' || k || '>"</script><a href="' || k || '">' || k || '</a><img src=' || k || '?x><img src="' || v || '"><p title="' || k AS html FROM p""")
def rewritten_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of pictures in markup of every kind: quotes of both kinds and none, upper case, > in a value, references, a comment, a script, a tag that never ends."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("k"), F.concat(F.lit("/r/"), F.col("page_id").cast("string"), F.lit('?a=1&b="2')).alias("v"))
    parts = ["<IMG SRC=", "k", "><img alt=\">\" src='", "k", "'/><img\ndata-src=\"", "k", '" src = "', "k", '"><!-- <img src="', "k", '"> --><script>"<img src=', "k", '>"</script><a href="', "k", '">', "k", "</a><img src=", "k", "?x><img src=\"&#112;", "rest", '"><p title="', "k"]
    html = F.concat(*(F.expr("substring(k, 2)") if x == "rest" else F.col("k") if x == "k" else F.lit(x) for x in parts))
    return rows.select("page_id", markup.rewrite_attribute(html, "img", "src", F.create_map("k", "v")).alias("html"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, count(*) AS requests, count(*) - 2 AS refused FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.rate_limited(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 2, "1 day")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "requests", "refused")


@query("""WITH f AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 12 HOURS AS new FROM events WHERE event_type IN ('error', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS failures FROM s GROUP BY user_id, n HAVING count(*) >= 3""")
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type IN ('error', 'view')").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rules.lockouts(failed, "user_id", "ts", 3, "12 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "failures")


@query("""SELECT event_id, round(CASE WHEN value <= 6 THEN 1.0 WHEN value <= 24 THEN 1.0 + (0.7 - 1.0) * (value - 6) / 18 WHEN value <= 72 THEN 0.7 + (0.3 - 0.7) * (value - 24) / 48 WHEN value <= 336 THEN 0.3 + (0.0 - 0.3) * (value - 72) / 264 ELSE 0 END, 6) AS by_hours,
  round(1 / (1 + exp(-greatest(-40.0, least(40.0, 0.5 + (value - 10) / 5 * 0.8)))), 6) AS probability, CASE WHEN value < 5 THEN 'severe' WHEN value < 12 THEN 'warning' ELSE 'ok' END AS severity FROM events""")
def scored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.piecewise(v, scoring.BY_HOURS), 6).alias("by_hours"), F.round(scoring.logistic([(v, 10.0, 5.0, 0.8)], 0.5), 6).alias("probability"), decisions.severity(v, 12.0, 5.0).alias("severity"))


@query("SELECT event_id FROM events WHERE props::JSON ->> '$.k' = '42'")
def audit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.audit(table(spark, sf_dir, "events").withColumnRenamed("props", "payload"), "$.k", "42").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.join(events.where("event_type = 'error' AND value > 100").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


