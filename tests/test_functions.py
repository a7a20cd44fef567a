import datetime as dt

import pytest

from pyspark.sql import functions as F

from darkroom.functions import decisions, geo, scoring, texts, times, vectors


def value(spark, column, **given):
    row = spark.range(1)
    for k, v in given.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


def test_years_and_dates(spark):
    text = F.lit("2024-2026家庭旅行 2025年05月01日-2025年05月03日")
    assert value(spark, texts.years(text)) == [2024, 2026, 2025]
    assert value(spark, texts.dates(text)) == ["2025-05-01", "2025-05-03"]
    assert value(spark, texts.years(F.lit("1950-2020"))) == [1950, 2020]
    assert value(spark, texts.years(F.lit(None).cast("string"))) == []


def test_names(spark):
    assert value(spark, texts.slugify(F.lit("  Our Trip! 2 "))) == "our-trip-2"
    assert value(spark, texts.slugify(F.lit("旅行"))) == "project"
    assert value(spark, texts.safe_name(F.lit(' a:b/c d. '))) == "a_b_c_d"
    assert value(spark, texts.safe_name(F.lit("..."))) == "album"
    assert value(spark, texts.chapter_name(F.lit("2024年5月1日 · 海边"), F.lit("x"))) == "海边"
    assert value(spark, texts.chapter_name(F.lit("2024年5月"), F.lit(" "))) == "未命名章节"
    assert value(spark, texts.screenshot(F.lit("Screen Shot 1.png"))) is True
    assert value(spark, texts.html_text(F.lit("<b>'&"), 80)) == "&lt;b&gt;&#x27;&amp;"


def test_tags(spark):
    tags = lambda *t: texts.scene_tags(F.array(*map(F.lit, t)))
    assert value(spark, texts.jaccard(tags("Beach ", "png_format"), tags("beach", "sun"))) == 0.5
    assert value(spark, texts.jaccard(tags("png_format"), tags("beach"))) is None


def test_labels(spark):
    t = lambda *d: F.lit(dt.datetime(*d))
    label = lambda a, b: value(spark, times.range_label(t(*a), t(*b)))
    assert label((2024, 5, 1), (2024, 5, 1, 9)) == "2024年5月1日"
    assert label((2024, 5, 1), (2024, 5, 3)) == "2024年5月1-3日"
    assert label((2024, 5, 1), (2024, 6, 3)) == "2024年5-6月"
    assert label((2024, 5, 1), (2025, 6, 3)) == "2024-2025"
    assert value(spark, times.range_label(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))) == "未知时间"
    assert value(spark, times.lenient(F.lit("2024:05:06 07:08:09"))) == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert value(spark, times.lenient(F.lit("nothing"))) is None


def test_constraint(spark):
    c = lambda taken, years=(), start=None, end=None: value(spark, times.constraint(F.lit(taken).cast("timestamp"), F.lit(list(years)).cast("array<int>") if years else F.array().cast("array<int>"), F.lit(start).cast("date"), F.lit(end).cast("date")))
    assert c(None, [2024]) == "review"
    assert c("2023-01-01", [2024]) == "exclude_year"
    assert c("2024-01-01", [2024]) == "match"
    assert c("2024-01-01", start="2024-02-01") == "exclude_dates"
    assert c(None) == "none"


def test_geo_and_vectors(spark):
    d = lambda *x: geo.haversine_km(*map(F.lit, x))
    assert abs(value(spark, d(0.0, 0.0, 0.0, 180.0)) - 3.141592653589793 * geo.EARTH_KM) < 1e-6
    assert value(spark, d(91.0, 0.0, 0.0, 0.0)) is None
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, vectors.normalized(v(3.0, 4.0))) == [0.6, 0.8]
    assert value(spark, vectors.normalized(v(0.0, 0.0))) is None
    assert value(spark, vectors.normalized(v(float("nan"), 1.0))) is None
    assert value(spark, vectors.dot(v(1.0), v(1.0, 2.0))) is None
    assert value(spark, vectors.hamming(F.lit("0"), F.lit("ff"))) == 8
    assert value(spark, vectors.hamming(F.lit("ffffffffffffffff"), F.lit("0"))) == 64
    assert value(spark, vectors.hamming(F.lit(""), F.lit("0"))) is None


def test_scores(spark):
    assert value(spark, scoring.signal(F.lit(0.2), F.lit(0.0))) == 0.2
    assert abs(value(spark, scoring.signal(F.lit(0.2), F.lit(0.4))) - 0.1) < 1e-12
    assert value(spark, scoring.weighted([(F.lit(None).cast("double"), 0.5), (F.lit(0.4), 0.5)])) == 0.4
    assert value(spark, scoring.weighted([(F.lit(None).cast("double"), 0.5)], 1.0)) == 1.0
    low, high = scoring.wilson(F.lit(0), F.lit(0))
    assert (value(spark, low), value(spark, high)) == (1.0, 1.0)
    assert value(spark, scoring.interpolated(F.lit(0.5), [0.0, 1.0], [0.2, 0.4])) == pytest.approx(0.3)


def test_decisions(spark):
    none = F.lit(None).cast("string")
    assert value(spark, decisions.included(none)) is True
    assert value(spark, decisions.included(F.lit("remove"))) is False
    assert value(spark, decisions.review_status(none, F.lit("keep"))) == "included"
    assert value(spark, decisions.review_status(none, none)) == "unanalyzed"
    assert value(spark, decisions.effective(F.lit(""), F.lit("keep"))) == "keep"
    assert value(spark, decisions.resume_step(none)) == "upload"
    assert value(spark, decisions.orientation(F.lit(113), F.lit(100))) == "landscape"
    assert value(spark, decisions.orientation(F.lit(0), F.lit(100))) == "unknown"
    phase = lambda *x: value(spark, decisions.workspace_phase(*[F.lit(v) for v in x]))
    assert phase("review_pending", 1, None, 2) == "needs_analysis"
    assert phase("review_pending", 2, None, 2) == "review_theme_photos"
    assert phase("confirmed", 1, 2, 2) == "ready_to_cluster"
