"""Queries on faces, nested settings, proposed layouts, constraints and calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import structures
from darkroom.operators import control, evaluation, faces, images, layout, theme
from darkroom.plans.analogs import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as faces in their orders' photos."""
    tenth = lambda c, m: (F.col(c) % m).cast("double") / 10
    box = F.struct(tenth("l_partkey", 6).alias("x"), tenth("l_suppkey", 6).alias("y"), F.lit(0.3).alias("width"), F.lit(0.3).alias("height"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"), (F.col("l_linenumber") + 10 * (F.col("l_partkey") * 100_000 + F.col("l_suppkey"))).alias("face"), F.col("l_quantity").alias("score"), box.alias("box"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount") * 10).alias("clarity"), F.when(F.col("l_discount") < 0.02, "severe").otherwise("ok").alias("severity"),
        (F.col("l_returnflag") == "R").alias("closed_eye"), (F.col("l_linestatus") == "O").alias("edge_crop"), (F.col("l_tax") > 0.05).alias("occlusion"), (F.col("l_quantity") >= 25).alias("eligible"),
    )


@query("""SELECT l_orderkey AS photo_id, count(*) AS detected, count(*) FILTER (l_linenumber % 3 > 0) AS analyzed, round(coalesce(quantile_cont(l_discount * 10, 0.2) FILTER (l_linenumber % 3 > 0), 0), 4) AS clarity_p20,
  count(*) FILTER (l_returnflag = 'R') AS closed_eye, count(*) FILTER (l_linestatus = 'O') AS edge_crop, count(*) FILTER (l_tax > 0.05) AS occlusion, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 25) AS high_value_closed_eye,
  count(*) FILTER (l_linestatus = 'O' AND l_quantity >= 25) AS high_value_edge_crop, count(*) FILTER (l_tax > 0.05 AND l_quantity >= 25) AS high_value_occlusion, count(*) FILTER (l_discount < 0.02 AND l_quantity >= 25) AS high_value_blur FROM lineitem GROUP BY 1""")
def face_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.summary(detected(spark, sf_dir), "photo_id")


#: Share of the overlap of two boxes of 0.3 by 0.3.
IOU = """(greatest(0.0, least({a}.x + 0.3, {b}.x + 0.3) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + 0.3, {b}.y + 0.3) - greatest({a}.y, {b}.y)))"""
IOU = f"({IOU} / (0.3 * 0.3 + 0.3 * 0.3 - {IOU}))"
BOXES = "f AS (SELECT l_orderkey AS photo_id, l_linenumber + 10 * (l_partkey * 100000 + l_suppkey) AS face, l_quantity AS score, (l_partkey % 6)::DOUBLE / 10 AS x, (l_suppkey % 6)::DOUBLE / 10 AS y FROM lineitem)"


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, face) AS n FROM f),
r AS (SELECT photo_id, n, [struct_pack(face := face, x := x, y := y)] AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.photo_id, o.n, CASE WHEN len(list_filter(kept, lambda k: {IOU.format(a="k", b="o")} >= 0.35)) = 0 THEN list_append(kept, struct_pack(face := o.face, x := o.x, y := o.y)) ELSE kept END FROM r JOIN o ON o.photo_id = r.photo_id AND o.n = r.n + 1),
l AS (SELECT photo_id, arg_max(kept, n) AS kept FROM r GROUP BY 1) SELECT photo_id, unnest(kept).face AS face FROM l""")
def kept_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.suppressed(detected(spark, sf_dir), "photo_id").select("photo_id", "face")


@query(f"""WITH {BOXES}, p AS (SELECT a.photo_id, a.face, b.face AS landmark, {IOU.format(a="a", b="b")} AS share FROM f a JOIN f b ON a.photo_id = b.photo_id WHERE a.face % 2 = 1 AND b.face % 2 = 0)
SELECT photo_id, face, landmark, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, face ORDER BY share DESC, landmark) AS n FROM p WHERE share >= 0.15) WHERE n = 1""")
def matched_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = detected(spark, sf_dir)
    marks = every.where("face % 2 = 0").withColumnRenamed("face", "landmark")
    return faces.matched(every.where("face % 2 = 1"), marks, "photo_id").withColumn("share", F.round("share", 6))


#: Share of the overlap of two boxes.
SHARE = """(greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"""
SHARE = f"({SHARE} / ({{a}}.w * {{a}}.h + {{b}}.w * {{b}}.h - {SHARE}))"


@query(f"""WITH RECURSIVE ph AS (SELECT o_orderkey AS photo_id, 2000 + o_orderkey % 5 * 400 AS pw, 1000 + o_custkey % 4 * 700 AS ph FROM orders),
l AS (SELECT l_orderkey AS photo_id, l_linenumber AS line, l_linenumber + 10 * (l_partkey * 100000 + l_suppkey) AS face, l_quantity AS score, (l_suppkey % 6)::DOUBLE / 10 AS bx, (l_partkey % 6)::DOUBLE / 10 AS yy, CASE WHEN l_linenumber = 1 THEN (l_partkey % 8 + 1)::DOUBLE / 100 ELSE 0.3::DOUBLE END AS s FROM lineitem),
f AS (SELECT photo_id, face, score, 0 AS left0, 0 AS top0, pw AS tw, ph AS th, bx, yy, s, pw, ph FROM ph JOIN l USING (photo_id) WHERE line = 1),
wanted AS (SELECT ph.*, CAST(pw * 3 // 5 AS INT) AS tw, CAST(ph * 3 // 5 AS INT) AS th FROM ph LEFT JOIN (SELECT photo_id, max(least(s * pw, s * ph)) AS side FROM f GROUP BY 1) USING (photo_id) WHERE greatest(pw, ph) > 2400 AND NOT coalesce(side >= 96, false)),
t AS (SELECT photo_id, face, score, line % 2 * (pw - tw) AS left0, line % 4 // 2 * (ph - th) AS top0, tw, th, bx, yy, s, pw, ph FROM wanted JOIN l USING (photo_id) WHERE line > 1),
b AS (SELECT photo_id, face, score, (left0 + bx * tw) / pw AS x, (top0 + yy * th) / ph AS y, s * tw / pw AS w, s * th / ph AS h FROM (SELECT * FROM f UNION ALL SELECT * FROM t)),
o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, face) AS n FROM b),
r AS (SELECT photo_id, n, [struct_pack(face := face, x := x, y := y, w := w, h := h)] AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.photo_id, o.n, CASE WHEN len(list_filter(kept, lambda k: {SHARE.format(a="k", b="o")} >= 0.35)) = 0 THEN list_append(kept, struct_pack(face := o.face, x := o.x, y := o.y, w := o.w, h := o.h)) ELSE kept END FROM r JOIN o ON o.photo_id = r.photo_id AND o.n = r.n + 1),
k AS (SELECT photo_id, unnest(arg_max(kept, n)) AS face FROM r GROUP BY 1) SELECT photo_id, face.face AS face, round(face.x, 6) AS x, round(face.y, 6) AS y, round(face.w, 6) AS width FROM k""")
def tiled_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of whole photos and of the parts of large ones without a clear face; lines of orders stand for what a detector finds."""
    photos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo_id"), (2000 + F.col("o_orderkey") % 5 * 400).cast("int").alias("width"), (1000 + F.col("o_custkey") % 4 * 700).cast("int").alias("height"))
    size = F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") % 8 + 1) / 100).otherwise(0.3)
    box = F.struct(((F.col("l_suppkey") % 6).cast("double") / 10).alias("x"), ((F.col("l_partkey") % 6).cast("double") / 10).alias("y"), size.alias("width"), size.alias("height"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + 10 * (F.col("l_partkey") * 100000 + F.col("l_suppkey"))).alias("face"), F.col("l_quantity").alias("score"), box.alias("box"))

    def detect(parts: DataFrame) -> DataFrame:
        whole = F.col("tile_width") == F.col("width")
        corner = (F.col("left") > 0).cast("int") + 2 * (F.col("top") > 0).cast("int")
        return parts.join(lines, "photo_id").where(F.when(whole, F.col("line") == 1).otherwise((F.col("line") > 1) & (F.col("line") % 4 == corner))).drop("line")

    out = faces.detected_by_tiles(photos, detect)
    return out.select("photo_id", "face", F.round("box.x", 6).alias("x"), F.round("box.y", 6).alias("y"), F.round("box.width", 6).alias("width"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN p_partkey % 3 > 0 THEN 'only.x=' || p_name END,
  CASE WHEN p_partkey % 3 > 0 THEN 'size.a=' || p_size END, CASE WHEN p_partkey % 2 > 0 THEN 'size.b=' || p_type WHEN p_partkey % 3 > 0 THEN 'size.b=' || p_brand END, CASE WHEN p_partkey % 2 > 0 THEN 'size.c=1' END], lambda x: x IS NOT NULL), ';') END AS merged FROM part""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    old = F.create_map(F.lit("only"), F.create_map(F.lit("x"), F.col("p_name")), F.lit("size"), F.create_map(F.lit("a"), text("p_size"), F.lit("b"), F.col("p_brand")))
    new = F.create_map(F.lit("size"), F.create_map(F.lit("b"), F.col("p_type"), F.lit("c"), F.lit("1")))
    out = structures.merged(F.when(F.col("p_partkey") % 3 > 0, old), F.when(F.col("p_partkey") % 2 > 0, new))
    flat = F.flatten(F.transform(F.map_entries(out), lambda e: F.transform(F.map_entries(e["value"]), lambda i: F.concat(e["key"], F.lit("."), i["key"], F.lit("="), i["value"]))))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(F.array_sort(flat), ";"), F.lit("")).alias("merged"))


@query("""SELECT user_id, arg_min(value, struct_pack(ts, event_id)) FILTER (event_type = 'purchase') AS paid, arg_min(event_id, struct_pack(ts, event_id)) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("failed"))
    return control.first_known(rows, ["user_id"], ["ts", "event_id"], "paid", "failed")


@query("""WITH c AS (SELECT l_orderkey, l_quantity::INT % 3 AS dimension, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT l_orderkey, dimension FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, dimension) AS r FROM c) WHERE r = 1""")
def usual_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 3).alias("dimension"))
    return control.most_common(rows, ["l_orderkey"], "dimension", "l_linenumber")


@query("""WITH s AS (SELECT o_custkey AS page, list(o_orderkey ORDER BY o_orderkey) AS ids, arg_min(o_orderpriority, o_orderkey) AS said FROM orders GROUP BY 1), o AS (SELECT *, CASE WHEN page % 3 = 0 THEN list_reverse(ids) ELSE ids END AS ordered FROM s)
SELECT page, array_to_string(ordered, ',') AS ordered, array_to_string(list_transform(ordered, lambda i: i || ':' || CASE WHEN i = ids[1] THEN left(said, 6) ELSE '' END), ',') AS captions FROM o""")
def settled_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(first.alias("rows")).withColumn("photos", F.col("rows.o_orderkey"))
    # a third of the proposals name every photo, one of them twice and a stranger; the others leave one out
    whole = F.concat(F.reverse("photos"), F.slice("photos", 1, 1), F.array(F.lit(-1).cast("long")))
    caption = lambda i, t: F.struct(i.alias("photo_id"), t.alias("text"))
    said = F.array(caption(F.col("photos")[0], F.concat(F.lit("  "), F.col("rows")[0]["o_orderpriority"])), caption(F.col("photos")[0], F.lit("late")), caption(F.lit(-1).cast("long"), F.lit("odd")))
    rows = by.withColumns({"proposed": F.when(F.col("page") % 3 == 0, whole).otherwise(F.slice("photos", 2, 10_000)), "captions": said})
    out = layout.settled(rows, 6)
    line = F.transform("captions", lambda c: F.concat(c["photo_id"].cast("string"), F.lit(":"), c["text"]))
    return out.select("page", F.array_join("ordered", ",").alias("ordered"), F.array_join(line, ",").alias("captions"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 148 WHEN 2 THEN 200 ELSE 210 END AS width, CASE p_size % 4 WHEN 1 THEN 210 WHEN 2 THEN 200 ELSE 297 END AS height,
  CASE p_size % 5 WHEN 0 THEN 'full_page' WHEN 1 THEN 'half_half' WHEN 2 THEN 'grid_4' WHEN 3 THEN 'two_column' ELSE 'mosaic' END AS template FROM part""")
def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    asked = F.when(k == 0, "Make it FULL, in two").when(k == 1, "对半 please").when(k == 2, "四图").when(k == 3, "Two of them").otherwise("as it is")
    mm = layout.page_mm(F.element_at(F.array(F.lit("A4"), F.lit("A5"), F.lit("square_10inch"), F.lit("B7")), (F.col("p_size") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", mm["width"].alias("width"), mm["height"].alias("height"), layout.asked_template(asked, F.lit("mosaic")).alias("template"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([2000 + doc_id % 7] || CASE WHEN doc_id % 2 = 0 THEN [1990 + doc_id % 9] ELSE [] END)), ',') AS years,
  CASE WHEN doc_id % 2 = 0 THEN (1990 + doc_id % 9) || '-03-05' ELSE '2001-01-01' END AS start_date, 'seen' || CASE WHEN doc_id % 2 = 0 THEN ',user_input' ELSE '' END AS evidence FROM documents""")
def theme_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    years = F.array(F.concat((2000 + i % 7).cast("string")), F.lit("12"), F.lit("soon"))
    asked = F.when(i % 2 == 0, F.concat(F.lit("spring "), (1990 + i % 9).cast("string"), F.lit("年3月5日")))
    got = theme.constraints(years, F.lit("2001-01-01"), F.lit("2001-02-01"), F.array(F.lit(" seen "), F.lit(""), F.lit("seen")), asked)
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("c")).select("doc_id", F.array_join("c.years", ",").alias("years"), "c.start_date", F.array_join("c.evidence", ",").alias("evidence"))


@query("""WITH a AS (SELECT o_custkey AS album, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'exclude' WHEN o_orderstatus = 'O' THEN 'review' ELSE 'keep' END AS d FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_custkey AS album, count(*) AS n FROM orders GROUP BY 1)
SELECT album, coalesce(array_to_string(list(id ORDER BY id) FILTER (d = 'exclude'), ','), '') AS excluded, coalesce(array_to_string(list(id ORDER BY id) FILTER (d = 'review'), ','), '') AS review, round(count(*)::DOUBLE / any_value(n), 4) AS coverage FROM a JOIN n USING (album) GROUP BY 1""")
def relevance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album"), i.alias("photo_id"), F.when(i % 4 == 0, "exclude").when(i % 4 == 1, "").alias("user_decision"), F.when(F.col("o_orderstatus") == "O", "review").otherwise("keep").alias("suggested_decision"))
    out = theme.assessed(rows.where("photo_id % 3 > 0"), rows, "album")
    return out.select("album", F.array_join("excluded", ",").alias("excluded"), F.array_join("review", ",").alias("review"), "coverage")


@query("""SELECT p_partkey, p_partkey % 5 > 0 AND p_size % 7 > 0 AND p_size % 3 > 0 AND p_retailprice >= 1000 AS enabled FROM part""")
def usable_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda *xs: F.array(*(x if isinstance(x, F.Column) else F.lit(float(x)) for x in xs))
    some = lambda **k: F.struct(*(v.alias(n) for n, v in k.items()))
    scores = lambda p: F.create_map(F.lit("candidate_precision"), p, F.lit("relevant_recall"), F.lit(0.8), F.lit("false_exclusion_rate"), F.lit(0.01))
    c = some(
        enabled=F.lit(True), signal=number(0, F.when(F.col("p_size") % 7 > 0, 0.5).otherwise(1.0), 1), probability=number(0, 0.5, 1), exclude_max=F.when(F.col("p_size") % 3 == 0, 0.9), keep_min=F.lit(None).cast("double"),
        features=F.array(F.lit("a"), F.lit("b")), coefficients=number(1, 2), means=number(0, 0), scales=number(1, F.when(F.col("p_partkey") % 5 > 0, 1.0).otherwise(0.0)), requirements_met=F.lit(True), metrics=scores(F.col("p_retailprice")), gates=scores(F.lit(1000.0)),
    )
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", evaluation.calibration_enabled(F.col("c")).alias("enabled"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS named, count(*) FILTER (l_returnflag <> 'R') AS fallback, arg_min(provider, struct_pack(l_linenumber, l_suppkey)) FILTER (l_returnflag = 'R') AS provider FROM (SELECT *, 'p' || (l_suppkey % 3) AS provider FROM lineitem) GROUP BY 1""")
def naming_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("l_returnflag") == "R"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey").alias("nth"), F.when(named, True).alias("named"), F.when(named, F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string"))).otherwise("").alias("provider"))
    return evaluation.naming_outcomes(rows, "l_orderkey", "nth")


#: Measures of pictures made from keys: of each the factor and the prime that make a share of it.
MEASURES = {
    "flat": (37, 101), "axis_edges": (53, 103), "colours": (11, 499), "a_entropy": (17, 107), "b_entropy": (19, 109), "a_informative": (23, 113), "b_informative": (29, 127), "a_p90": (31, 131), "a_clear": (41, 997), "b_clear": (43, 991),
    "a_motion": (47, 137), "b_motion": (59, 139), "a_steep": (61, 149), "b_steep": (67, 151), "dark": (71, 157), "bright": (73, 163), "p95": (79, 167), "p05": (83, 173), "clipped_tiles": (89, 179), "exposure": (97, 983),
}
_SHARES = ", ".join(f"({{i}} * {p} % {q})::DOUBLE / {q}{' * 4' if n.endswith('entropy') else ' / 2' if n in ('a_p90', 'a_clear', 'b_clear') else ''} AS {n}" for n, (p, q) in MEASURES.items())


@query(f"""WITH i AS (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem), m AS (
  SELECT id, id % 53 = 0 AS failed, id % 3 = 0 AS camera, id % 29 = 0 AS shot, CASE WHEN id % 5 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS type, 2 * (id * 7 % 1021) + 101 AS w, 2 * (id * 13 % 1019) + 101 AS h, {_SHARES.replace("{i}", "id")} FROM i), k AS (
  SELECT *, CASE WHEN shot OR coalesce(NOT failed AND type = 'image/png' AND NOT camera AND flat >= 0.55 AND axis_edges >= 0.62, false) THEN 'screenshot_or_graphic' WHEN camera THEN 'camera_photo' ELSE 'unknown' END AS capture_kind,
    greatest(a_entropy, b_entropy) >= 2 AND greatest(a_informative, b_informative) >= 0.08 AS texture FROM m), d AS (
  SELECT *, CASE WHEN capture_kind = 'camera_photo' THEN 'photographic' WHEN capture_kind = 'screenshot_or_graphic' AND NOT failed AND flat >= 0.68 AND colours <= 0.08 THEN 'illustration' WHEN capture_kind = 'screenshot_or_graphic' THEN 'mixed'
      WHEN NOT failed AND flat >= 0.72 AND colours <= 0.06 THEN 'illustration' ELSE 'unknown' END AS visual_domain,
    NOT failed AND texture AND a_p90 < 0.18 AND a_clear < 0.16 AND b_clear < 0.18 AND (greatest(a_motion, b_motion) >= 0.30 OR greatest(a_steep, b_steep) < 0.15) AS hard_reject FROM k), v AS (
  SELECT *, CASE WHEN hard_reject THEN 'severe' WHEN NOT texture THEN 'undetermined' WHEN least(a_clear, b_clear) < 0.45 THEN 'warning' ELSE 'ok' END AS sharpness,
    CASE WHEN capture_kind = 'screenshot_or_graphic' OR visual_domain = 'illustration' THEN 'not_applicable' WHEN (dark >= 0.45 AND p95 <= 0.35 OR bright >= 0.45 AND p05 >= 0.65) AND clipped_tiles >= 0.35 THEN 'severe'
      WHEN (dark >= 0.20 AND p95 <= 0.50 OR bright >= 0.20 AND p05 >= 0.50) AND clipped_tiles >= 0.20 THEN 'warning' ELSE 'ok' END AS exposed,
    CASE WHEN least(w, h) < 320 THEN 'severe' WHEN least(w, h) < 800 THEN 'warning' ELSE 'ok' END AS resolution, least(1.0, least(w, h) / 1600) AS size FROM d), c AS (
  SELECT *, CASE WHEN sharpness = 'undetermined' THEN 0.75 ELSE (a_clear + b_clear) / 2 END AS clear FROM v)
SELECT id, capture_kind, visual_domain, hard_reject, CASE WHEN hard_reject THEN 'remove' WHEN failed THEN 'review' ELSE 'keep' END AS suggestion, CASE WHEN failed THEN 0.2 WHEN hard_reject THEN 0.99 ELSE 0.9 END AS confidence,
  array_to_string(list_filter([CASE WHEN failed THEN 'analysis_failed' END, CASE WHEN NOT failed AND sharpness <> 'ok' THEN 'sharpness_' || sharpness END, CASE WHEN NOT failed AND exposed IN ('severe', 'warning') THEN 'exposure_' || exposed END,
    CASE WHEN NOT failed AND resolution <> 'ok' THEN 'resolution_' || resolution END], lambda x: x IS NOT NULL), ',') AS issues,
  round(CASE WHEN failed THEN 10 * (0.8 + 0.2 * size) WHEN exposed = 'not_applicable' THEN 10 * (0.65 * clear + 0.35 * size) ELSE 10 * (0.5 * clear + 0.3 * exposure + 0.2 * size) END, 2) AS quality FROM c""")
def picture_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture kinds, domains, severities, issues, quality and suggestions of pictures by their measures."""
    i = F.col("id")
    # a function over rows of literals: the expressions of all measures in a row would be a method too long for the JVM to compile
    parts = [(p, q, 4.0 if n.endswith("entropy") else 1.0, 2.0 if n in ("a_p90", "a_clear", "b_clear") else 1.0) for n, (p, q) in MEASURES.items()]
    factors = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(t).alias("t"), F.lit(d).alias("d")) for p, q, t, d in parts))
    m = F.map_from_arrays(F.array(*map(F.lit, MEASURES)), F.transform(factors, lambda f: (i * f["p"] % f["q"]).cast("double") / f["q"] * f["t"] / f["d"]))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    rows = rows.select("id", (2 * (i * 7 % 1021) + 101).cast("int").alias("width"), (2 * (i * 13 % 1019) + 101).cast("int").alias("height"), F.when(i % 53 > 0, m).alias("m"))
    name = F.when(i % 29 == 0, "Screenshot 1.png").otherwise("a.jpg")
    out = images.judged(rows, name, F.when(i % 5 == 0, "image/png").otherwise("image/jpeg"), i % 3 == 0)
    return out.select("id", "capture_kind", "visual_domain", "hard_reject", "suggestion", "confidence", F.array_join("issues", ",").alias("issues"), "quality")
