"""Faces, nested maps, proposed layouts and calibrations on small cases, with nulls."""

from pyspark.sql import functions as F

from darkroom.functions import structures
from darkroom.operators import control, evaluation, faces, layout, theme


def test_overlapping_faces_and_landmarks(spark):
    box = lambda x: (x, 0.0, 1.0, 1.0)
    rows = [(1, 1, 0.9, box(0.0)), (1, 2, 0.8, box(0.4)), (1, 3, 0.7, box(0.8)), (2, 1, 0.5, box(0.0)), (2, 2, 0.5, box(0.0)), (3, 1, None, box(0.0)), (3, 2, 0.5, None)]
    df = spark.createDataFrame(rows, f"photo_id long, face long, score double, box {faces.BOX}")
    # the second goes, so the third, which overlaps it alone, stays; of equal ones the smaller id
    assert sorted((r.photo_id, r.face) for r in faces.suppressed(df, "photo_id").collect()) == [(1, 1), (1, 3), (2, 1)]
    marks = df.where("photo_id = 1 AND face <> 1").withColumnRenamed("face", "landmark")
    got = {r.face: r.landmark for r in faces.matched(df, marks, "photo_id").collect()}
    assert got == {1: 2, 2: 2, 3: 3}
    assert faces.suppressed(df.limit(0), "photo_id").count() == 0


def test_face_sums(spark):
    rows = [(1, 0.2, "severe", True, False, None, True), (1, 0.4, "ok", True, True, True, False), (1, None, None, None, None, None, None), (2, None, None, False, False, False, True)]
    df = spark.createDataFrame(rows, "photo_id long, clarity double, severity string, closed_eye boolean, edge_crop boolean, occlusion boolean, eligible boolean")
    got = {r.photo_id: r for r in faces.summary(df, "photo_id").collect()}
    assert (got[1].detected, got[1].analyzed, got[1].clarity_p20, got[1].closed_eye, got[1].high_value_closed_eye, got[1].high_value_blur, got[1].occlusion) == (3, 2, 0.24, 2, 1, 1, 1)
    assert (got[2].clarity_p20, got[2].analyzed) == (0.0, 0)


def test_nested_maps_and_lists(spark):
    cases = [({"a": {"x": "1", "y": "2"}}, {"a": {"y": "3"}, "b": {}}), (None, {"a": {"x": "1"}}), ({"a": {"x": "1"}}, None), (None, None), ({}, {})]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a map<string,map<string,string>>, b map<string,map<string,string>>")
    got = [r.m for r in df.select("i", structures.merged(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()]
    assert got == [{"a": {"x": "1", "y": "3"}, "b": {}}, {"a": {"x": "1"}}, {"a": {"x": "1"}}, None, None]
    lists = spark.createDataFrame([([" a", "b", "a ", "", None, "c"],), (None,), ([],)], "t array<string>")
    assert [r.s for r in lists.select(structures.some_texts(F.col("t"), 2).alias("s")).collect()] == [["a", "b"], [], []]
    knots = spark.createDataFrame([([0.0, 1.0], [0.0, 1.0]), ([1.0, 1.0], [0.0, 1.0]), ([0.0, 1.0], [0.5, 0.2]), ([0.0], [0.0]), ([0.0, 1.0], [0.0]), (None, None), ([0.0, 1.0], [0.0, 1.2])], "s array<double>, p array<double>")
    assert [r.u for r in knots.select(structures.usable_knots(F.col("s"), F.col("p")).alias("u")).collect()] == [True, *[False] * 6]


def test_first_and_most_common_values(spark):
    rows = spark.createDataFrame([("a", 2, None, 5), ("a", 1, "x", None), ("a", 3, "y", 5), ("b", 1, None, None)], "k string, n int, s string, v int")
    got = {r.k: (r.s, r.v) for r in control.first_known(rows, ["k"], ["n"], "s", "v").collect()}
    assert got == {"a": ("x", 5), "b": (None, None)}
    assert [(r.k, r.s) for r in control.most_common(rows, ["k"], "s", "n").collect()] == [("a", "x")]


def test_layouts_are_settled(spark):
    caption = "array<struct<photo_id:long,text:string>>"
    rows = [(1, [1, 2], [2, 1, 2, 9], [(1, " hi "), (1, "late")]), (2, [1, 2], [2], None), (3, [1], None, [(1, None)])]
    df = spark.createDataFrame(rows, f"page int, photos array<long>, proposed array<long>, captions {caption}")
    got = {r.page: (r.ordered, [c.text for c in r.captions]) for r in layout.settled(df).collect()}
    assert got == {1: ([2, 1], ["", "hi"]), 2: ([1, 2], ["", ""]), 3: ([1], [""])}


def test_constraints_and_outcomes(spark):
    one = spark.createDataFrame([(["2011", "soon"], "2009-12-31", None, ["a"], "hikes of 2010~2012, mostly 2012/7/9 and 2012/7/21"), (None, None, None, None, None)], "y array<string>, s string, e string, v array<string>, r string")
    got = [r.c for r in one.select(theme.constraints(*map(F.col, "ysevr")).alias("c")).collect()]
    assert (got[0].years, got[0].start_date, got[0].end_date, got[0].evidence) == ([2010, 2011, 2012], "2012-07-09", "2012-07-21", ["a", "user_input"])
    assert (got[1].years, got[1].start_date, got[1].evidence) == ([], None, [])
    rows = spark.createDataFrame([("a", 2, True, "q"), ("a", 1, True, ""), ("a", 3, None, None)], "k string, n int, named boolean, provider string")
    assert [tuple(r) for r in evaluation.naming_outcomes(rows, "k", "n").collect()] == [("a", 2, 1, "q")]


def test_codes_are_the_first_free(spark):
    names = [(1, "report"), (2, "report"), (3, "trip"), (4, "trip"), (5, "trip"), (6, "trip-2"), (7, "new"), (8, "x-05"), (9, "trip-2")]
    taken = ["report-2024", "trip", "trip-3", "trip-4", "new", "new-2", None, "x-5"]
    got = control.next_code(spark.createDataFrame(names, "name long, slug string"), spark.createDataFrame([(t,) for t in taken], "code string")).collect()
    assert dict(map(tuple, got)) == {1: "report", 2: "report-2", 3: "trip-5", 4: "trip-6", 5: "trip-7", 6: "trip-2", 7: "new-3", 8: "x-05", 9: "trip-2-2"}
    assert control.next_code(spark.createDataFrame([], "name long, slug string"), spark.createDataFrame([("a",)], "code string")).count() == 0


def test_moved_and_merged_photos(spark):
    now = spark.createDataFrame([(c, 10 * c + i, i) for c in (1, 2, 3) for i in range(3)], "chapter int, photo_id int, place int")
    moves = spark.createDataFrame([(1, 10, 0), (1, 21, 1)], "chapter int, photo_id int, nth int")
    of = lambda df, c: [r.photo_id for r in df.where(df.chapter == c).orderBy("place").collect()]
    got = layout.moved(now, moves)
    assert (of(got, 1), of(got, 2)) == ([10, 11, 12, 21], [20, 22])
    merges = spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "source int, target int")
    assert of(layout.merged(now, merges), 1) == [10, 11, 12, 20, 21, 22, 30, 31, 32]
    twice = now.unionByName(spark.createDataFrame([(2, 11, 9)], now.schema))
    assert of(layout.merged(twice, merges), 1) == [10, 11, 12, 20, 21, 22, 30, 31, 32]


def test_bundles(spark, tmp_path):
    from darkroom.sources import tables

    rows = [("a", 1, "preview", "<p>1</p>"), ("a", 1, "print", "<p>2</p>"), ("b", 4, "manifest", "{}")]
    books = spark.createDataFrame(rows, "album_id string, revision int, kind string, html string")
    tables.write_bundles(books, str(tmp_path / "out"))
    tables.write_bundles(books.where("kind = 'print'").withColumn("html", F.lit("<p>3</p>")), str(tmp_path / "out"))
    got = {str(p.parent.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")}
    assert got == {"album_id=a/revision=r1/kind=preview": "<p>1</p>\n", "album_id=a/revision=r1/kind=print": "<p>3</p>\n", "album_id=b/revision=r4/kind=manifest": "{}\n"}
