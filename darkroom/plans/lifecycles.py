"""Queries on entities over their life."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import decisions, texts
from darkroom.operators import lifecycle, settings
from darkroom.plans import pipelines
from darkroom.plans.analogs import PHOTOS, embedded, photos, table
from darkroom.plans.cleaning import WIDE_BURST, WIDE_NEAR
from darkroom.plans.timelines import STEPS, UNTIMED

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT c_custkey, coalesce(array_to_string(list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderdate, o_orderkey), ','), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    out = lifecycle.nested(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders, "orders", "o_orderdate", "o_orderkey")
    line = F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"].cast("string"), o["o_orderstatus"]))
    return out.select("c_custkey", F.coalesce(F.array_join(line, ","), F.lit("")).alias("orders"))


LOG = "CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END"


@query(f"""WITH l AS (SELECT user_id AS task_id, ts, event_id % 100 AS progress, 'e' || event_id AS error, {LOG} AS status FROM events), e AS (SELECT task_id, min(ts) AS stop FROM l WHERE status IN ('succeeded', 'failed') GROUP BY 1),
a AS (SELECT l.* FROM l LEFT JOIN e USING (task_id) WHERE stop IS NULL OR ts <= stop), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC) AS n, count(*) FILTER (WHERE status = 'running') OVER (PARTITION BY task_id) AS attempts FROM a)
SELECT task_id, status, CASE WHEN status = 'succeeded' THEN 100 ELSE progress END AS progress, CASE WHEN status = 'failed' THEN error END AS error, attempts FROM r WHERE n = 1""")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("ts").alias("at"), F.expr(LOG).alias("status"), (F.col("event_id") % 100).alias("progress"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    return lifecycle.states(rows)


@query("""SELECT p_partkey, p_size % 4 + CASE WHEN p_size % 3 = 0 OR p_brand LIKE '%1' THEN 1 ELSE 0 END AS revision FROM part""")
def render_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("revision"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("spec"))
    changed = table(spark, sf_dir, "part").where((F.col("p_size") % 3 == 0) | F.col("p_brand").like("%1")).select("p_partkey")
    after = before.join(changed.withColumn("_c", F.lit(True)), "p_partkey", "left").withColumn("title", F.when(F.col("_c"), F.concat("title", F.lit("!"))).otherwise(F.col("title"))).drop("_c")
    return lifecycle.revisions(before, after, "p_partkey", ["title", "brand", "spec"]).select("p_partkey", "revision")


@query("""SELECT c_custkey, 'o/' || o_orderkey AS path FROM customer JOIN orders ON o_custkey = c_custkey UNION SELECT c_custkey, 'p/' || c_name FROM customer""")
def deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("file"))
    return lifecycle.storage_keys(customer, "c_custkey", (orders, "file"), (customer.withColumn("cover", F.concat(F.lit("p/"), "c_name")), "cover"))


@query("""SELECT 'n' || n_nationkey AS node, 'flag/' || n_name AS path FROM nation WHERE n_regionkey = 1 UNION SELECT 'c' || c_custkey, 'card/' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION SELECT 'o' || o_orderkey, 'o/' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION SELECT 'l' || l_orderkey || '/' || l_linenumber, 'l/' || l_shipdate::DATE FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a region's nations, their customers, their orders and these orders' lines: four owners in a row."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda p, *c: F.concat(F.lit(p), F.concat_ws("/", *(F.col(x).cast("string") for x in c)))
    owns = t("nation").select(node("r", "n_regionkey").alias("owner"), node("n", "n_nationkey").alias("owned"))
    owns = owns.unionByName(t("customer").select(node("n", "c_nationkey").alias("owner"), node("c", "c_custkey").alias("owned"))).unionByName(t("orders").select(node("c", "o_custkey").alias("owner"), node("o", "o_orderkey").alias("owned")))
    owns = owns.unionByName(t("lineitem").select(node("o", "l_orderkey").alias("owner"), node("l", "l_orderkey", "l_linenumber").alias("owned")))
    files = t("nation").select(node("n", "n_nationkey").alias("node"), F.concat(F.lit("flag/"), "n_name").alias("path")).unionByName(t("customer").select(node("c", "c_custkey").alias("node"), F.concat(F.lit("card/"), "c_name").alias("path")))
    files = files.unionByName(t("orders").select(node("o", "o_orderkey").alias("node"), node("o/", "o_orderkey").alias("path")))
    files = files.unionByName(t("lineitem").select(node("l", "l_orderkey", "l_linenumber").alias("node"), F.concat(F.lit("l/"), F.col("l_shipdate").cast("date").cast("string")).alias("path")))
    start = t("region").where("r_regionkey = 1").select(node("r", "r_regionkey").alias("node"))
    return lifecycle.owned_keys(start, owns, files)


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages, count(DISTINCT page_id % 3) AS chapters, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def manifest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumns({"host": F.regexp_extract("url", "://([^/]*)", 1), "chapter": F.col("page_id") % 3})
    return lifecycle.manifest(rows, "host", "html", "chapter")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS artifact FROM part WHERE p_size % 4 IN (1, 2) AND p_partkey % 3 IN (0, 1)")
def exportable_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    albums = table(spark, sf_dir, "part").select("p_partkey", F.when(s == 1, "rendered").when(s == 2, "exported").otherwise("planned").alias("status"), F.when(k % 3 == 0, "new").alias("artifact_path"), F.when(k % 3 == 1, "old").alias("legacy_path"))
    return lifecycle.exportable(albums).select("p_partkey", "artifact")


@query("SELECT o_orderkey AS album, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE p END AS project_id FROM orders LEFT JOIN (SELECT c_custkey AS u, min(c_nationkey)::BIGINT AS p FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1) ON u = o_custkey")
def filled_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    albums = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("project_id"))
    projects = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("project_id"))
    return lifecycle.with_project(albums, projects).select("album", "project_id")


@query("SELECT p_size % 10 AS stage, min(p_name) AS value FROM part WHERE p_size % 10 < 6 GROUP BY 1 UNION ALL SELECT s, 'default' FROM (VALUES (6), (7), (8), (9)) t(s)")
def seeded_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "part").where("p_size % 10 < 6").groupBy((F.col("p_size") % 10).alias("stage")).agg(F.min("p_name").alias("value"))
    return lifecycle.seeded(have, spark.range(10).select(F.col("id").cast("int").alias("stage"), F.lit("default").alias("value")), "stage")


@query("SELECT c_custkey, coalesce(n, 0) AS photo_count, coalesce(n, 0) <> c_custkey % 20 AS corrected FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def recounted_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    albums = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 20).alias("photo_count"))
    return lifecycle.recounted(albums, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT l_suppkey % 50 AS album, count(*) AS chapters, sum(l_linenumber)::BIGINT AS segments, count_if(l_discount < 0.05)::BIGINT AS low_quality FROM lineitem GROUP BY 1""")
def clustering_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("album"), F.col("l_orderkey").alias("nth"), F.col("l_linenumber").alias("segments"), F.when(F.col("l_discount") < 0.05, 0.5).otherwise(0.9).alias("quality"), F.lit(2).alias("auto_k"), F.lit(None).cast("int").alias("selected_k"))
    some = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("album"), F.lit(1).alias("embedding"))
    return lifecycle.run_metrics(rows, some, "album").select("album", "chapters", "segments", "low_quality")


@query("SELECT o_orderkey, sha256(o_orderkey || ':' || o_orderpriority) AS hash, CASE o_orderstatus WHEN 'O' THEN 'cleaning' WHEN 'F' THEN 'planning' ELSE 'upload' END AS step, left(sha256(lower(trim(o_orderpriority))), 12) AS theme FROM orders")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "F", "clustered")
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.failure_hash(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("hash"), decisions.resume_step(status).alias("step"), F.substring(F.sha2(F.lower(F.trim("o_orderpriority")), 256), 1, 12).alias("theme"))


def _clean(spark: SparkSession, sf_dir: str) -> pipelines.Cleaned:
    rows = embedded(spark, sf_dir).withColumns({"hard_reject": F.col("photo_id") % 31 == 0, "confidence": F.lit(0.9), "faces": F.lit(None).cast("struct<detected:int,clarity_p20:double,closed_eye:int,occlusion:int,edge_crop:int,expression:int>")})
    return pipelines.clean(rows, WIDE_NEAR, WIDE_BURST)


@query()
def cleaning_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).photos.select("album_id", "photo_id", "suggestion", "decision", "exclusion")


@query()
def cleaning_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).queue.select("album_id", "item", "kind", "priority", "action")


KEPT = PHOTOS.replace("photos AS (", "every AS (", 1) + ", photos AS (SELECT * FROM every WHERE decision IS DISTINCT FROM 'remove')"


@query(f"""WITH {STEPS.replace(PHOTOS, KEPT)}, {UNTIMED}, c AS (
  SELECT p.album_id, p.photo_id, p.device, p.width, p.height, p.taken_at, coalesce(e.event, u.event, 1 << 30) AS chapter FROM photos p LEFT JOIN events2 e ON e.album_id = p.album_id AND e.photo_id = p.photo_id LEFT JOIN untimed u ON u.album_id = p.album_id AND u.photo_id = p.photo_id), n AS (
  SELECT *, row_number() OVER (PARTITION BY album_id, chapter ORDER BY taken_at IS NULL, taken_at, photo_id) - 1 AS n FROM c), g AS (
  SELECT *, n % 3 AS slot, dense_rank() OVER (PARTITION BY album_id ORDER BY chapter, n // 3) AS page FROM n), t AS (
  SELECT album_id, page, count(*) AS photos, count_if(height > width * 1.12) AS p, count_if(width > height * 1.12) AS l, string_agg('<figure>' || device || ' ' || photo_id || '</figure>', '' ORDER BY slot) AS body FROM g GROUP BY ALL), s AS (
  SELECT album_id, page, '<section class="' || CASE photos WHEN 1 THEN CASE WHEN l = 1 THEN 'cinema_landscape' WHEN p = 1 THEN 'gallery_portrait' ELSE 'full_page' END WHEN 2 THEN CASE WHEN p = 2 THEN 'half_half' WHEN l >= 1 THEN 'two_column' ELSE 'staggered_duo' END
    ELSE CASE WHEN p >= 2 THEN 'one_large_two_small' WHEN l >= 2 THEN 'triptych_strip' ELSE 'grid_3' END END || '">' || body || '</section>' AS html FROM t)
SELECT a.album_id, '<!doctype html><title>Album_' || a.album_id || '</title>' || coalesce(string_agg(html, '' ORDER BY page), '') AS html FROM (SELECT DISTINCT album_id FROM every) a LEFT JOIN s ON s.album_id = a.album_id GROUP BY a.album_id""")
def chapter_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by events of albums without embeddings, as books."""
    rows = photos(spark, sf_dir).withColumn("caption", F.concat("device", F.lit(" "), F.col("photo_id").cast("string")))
    titles = rows.select("album_id").distinct().withColumn("title", texts.safe_name(F.concat(F.lit("Album "), F.col("album_id").cast("string"))))
    return pipelines.books(pipelines.chapters(rows), titles, "caption")


# ---- providers of stages: nations as owners of configurations, orders as changes and requests ----

_STAGE = "CASE {i} % 4 WHEN 0 THEN 'chapter' WHEN 1 THEN 'chapter_embedding' WHEN 2 THEN 'layout' ELSE 'cleaning' END"
_PROVIDER = "CASE {i} % 3 WHEN 0 THEN 'openai_compatible' WHEN 1 THEN 'dashscope_multimodal_embedding' END"
_ALLOWED = "(({s} IN ('chapter', 'layout') AND {p} = 'openai_compatible') OR ({s} = 'chapter_embedding' AND {p} = 'dashscope_multimodal_embedding'))"
PROVIDERS = f"""held AS (SELECT o_custkey % 50 AS owner, {_STAGE.format(i="o_orderkey")} AS stage, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 5 > 0 GROUP BY ALL),
configs AS (SELECT *, {_PROVIDER.format(i="id")} AS provider_type, 'm' || id AS model FROM held),
asked AS (SELECT l_suppkey % 55 AS owner, {_STAGE.format(i="l_partkey")} AS stage, l_orderkey * 8 + l_linenumber AS seq, {_PROVIDER.format(i="l_partkey")} AS provider_type, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || l_partkey END AS model,
  CASE l_orderkey % 6 WHEN 0 THEN 'sk-' || l_returnflag || l_partkey || '-' || l_orderkey WHEN 1 THEN l_returnflag || l_partkey WHEN 2 THEN '' END AS api_key, CASE WHEN l_orderkey % 9 = 0 THEN l_linestatus = 'O' END AS is_active FROM lineitem),
fit AS (SELECT owner, stage, min(seq) AS seq FROM asked WHERE {_ALLOWED.format(s="stage", p="provider_type")} GROUP BY ALL),
judged AS (SELECT a.*, CASE WHEN a.stage = 'cleaning' THEN 'unknown_stage' WHEN c.id IS NULL THEN 'missing' WHEN NOT CASE WHEN a.provider_type IS NOT NULL THEN {_ALLOWED.format(s="a.stage", p="a.provider_type")}
  ELSE coalesce({_ALLOWED.format(s="a.stage", p="c.provider_type")}, false) OR coalesce(f.seq < a.seq, false) END THEN 'unsupported_provider' END AS reason
  FROM asked a LEFT JOIN configs c ON c.owner = a.owner AND c.stage = a.stage LEFT JOIN fit f ON f.owner = a.owner AND f.stage = a.stage)"""


def _stage(i: F.Column) -> F.Column:
    return F.when(i % 4 == 0, "chapter").when(i % 4 == 1, "chapter_embedding").when(i % 4 == 2, "layout").otherwise("cleaning")


def _provider(i: F.Column) -> F.Column:
    return F.when(i % 3 == 0, "openai_compatible").when(i % 3 == 1, "dashscope_multimodal_embedding")


def configurations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(configurations, changes) of owners' stages."""
    held = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").groupBy((F.col("o_custkey") % 50).alias("owner"), _stage(F.col("o_orderkey")).alias("stage")).agg(F.min("o_orderkey").alias("id"))
    text = F.lit(None).cast("string")
    configs = held.select("owner", "stage", "id", _provider(F.col("id")).alias("provider_type"), text.alias("base_url"), F.concat(F.lit("m"), "id").alias("model"), F.lit(True).alias("is_active"), F.lit(100).alias("priority"), text.alias("remark"), F.lit("").alias("api_key_masked"))
    o, named = F.col("l_orderkey") % 6, F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    key = F.when(o == 0, F.concat(F.lit("sk-"), named, F.lit("-"), F.col("l_orderkey").cast("string"))).when(o == 1, named).when(o == 2, "")
    changes = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 55).alias("owner"), _stage(F.col("l_partkey")).alias("stage"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), _provider(F.col("l_partkey")).alias("provider_type"), text.alias("base_url"),
        F.when(F.col("l_linenumber") % 3 == 0, named).alias("model"), F.when(F.col("l_orderkey") % 9 == 0, F.col("l_linestatus") == "O").alias("is_active"), F.lit(None).cast("int").alias("priority"), text.alias("remark"), key.alias("api_key"),
    )
    return configs, changes


@query(f"WITH {PROVIDERS} SELECT owner, stage, seq, reason FROM judged")
def provider_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.verdicts(*configurations(spark, sf_dir), ["owner"], "seq").select("owner", "stage", "seq", "reason")


@query(f"""WITH {PROVIDERS}, g AS (SELECT owner, stage, (max(struct_pack(s := seq, v := provider_type)) FILTER (provider_type IS NOT NULL)).v AS p, (max(struct_pack(s := seq, v := model)) FILTER (model IS NOT NULL)).v AS m, (max(struct_pack(s := seq, v := is_active)) FILTER (is_active IS NOT NULL)).v AS a,
  (max(struct_pack(s := seq, v := CASE WHEN length(api_key) <= 8 THEN repeat('*', length(api_key)) ELSE left(api_key, 4) || '****' || right(api_key, 4) END)) FILTER (api_key <> '')).v AS k FROM judged WHERE reason IS NULL GROUP BY ALL)
SELECT c.owner, c.stage, coalesce(p, provider_type) AS provider_type, coalesce(m, model) AS model, coalesce(a, true) AS is_active, coalesce(k, '') AS api_key_masked FROM configs c LEFT JOIN g ON g.owner = c.owner AND g.stage = c.stage""")
def provider_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.updated(*configurations(spark, sf_dir), ["owner"], "seq").select("owner", "stage", "provider_type", "model", "is_active", "api_key_masked")


@query(f"""WITH own AS (SELECT o_custkey % 80 AS project_id, CASE WHEN o_orderkey % 7 > 0 THEN {_STAGE.format(i="o_orderkey")} END AS stage, o_orderkey AS id, {_PROVIDER.format(i="o_orderkey")} AS provider, o_orderpriority AS model, o_orderkey % 9 = 0 AS active, o_orderkey % 5 AS priority, o_orderdate AS made FROM orders WHERE o_custkey % 80 > 20),
d AS (SELECT {_STAGE.format(i="s_suppkey")} AS stage, s_suppkey AS id, {_PROVIDER.format(i="s_suppkey")} AS provider, s_name AS model FROM supplier WHERE s_suppkey % 4 IN (0, 2) AND s_suppkey % 5 = 1),
w AS (SELECT DISTINCT o_custkey % 80 AS project_id, {_STAGE.format(i="o_orderkey")} AS stage FROM orders),
c AS (SELECT w.*, CASE WHEN o.stage IS NULL THEN 1 ELSE 0 END AS k, o.id, provider, model, priority, made, 'project_config' AS source FROM w JOIN own o ON o.project_id = w.project_id AND (o.stage = w.stage OR o.stage IS NULL) AND active
  UNION ALL SELECT w.*, 2, d.id, provider, model, 0, NULL, 'global_default_config' FROM w JOIN d ON d.stage = w.stage UNION ALL SELECT *, 3, NULL, 'openai_compatible', '', 0, NULL, 'env_fallback' FROM w)
SELECT project_id, stage, source, id AS config_id, provider, model FROM c QUALIFY row_number() OVER (PARTITION BY project_id, stage ORDER BY k, priority, made, id) = 1""")
def resolved_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = F.col("o_orderkey"), F.col("s_suppkey")
    orders = table(spark, sf_dir, "orders").withColumn("project_id", F.col("o_custkey") % 80)
    own = orders.where("project_id > 20").select("project_id", F.when(o % 7 > 0, _stage(o)).alias("stage"), o.alias("id"), _provider(o).alias("provider_type"), F.col("o_orderpriority").alias("model"), (o % 9 == 0).alias("is_active"), (o % 5).alias("priority"), F.col("o_orderdate").alias("created_at"))
    defaults = table(spark, sf_dir, "supplier").where("s_suppkey % 4 IN (0, 2)").select(_stage(s).alias("stage"), s.alias("id"), _provider(s).alias("provider_type"), F.col("s_name").alias("model"), (s % 5 == 1).alias("is_active"))
    return settings.resolved(orders.select("project_id", _stage(o).alias("stage")).distinct(), own, defaults)
