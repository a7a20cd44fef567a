import datetime as dt

from pyspark.sql import functions as F

from darkroom.operators import control, review, theme
from darkroom.sources import tables
from darkroom.streaming import rules


def test_stale_tasks_from_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    beats = [[("a", "running", at(0)), ("b", "running", at(0))], [("b", "running", at(8)), ("c", "done", at(8))], [("b", "done", at(14))], [("z", "done", at(60))], [("z", "done", at(61))]]
    for i, rows in enumerate(beats):
        spark.createDataFrame(rows, "task_id string, status string, beat timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    paths = sorted((tmp_path / "in").glob("*/*.parquet"))
    (tmp_path / "flat").mkdir()
    for i, p in enumerate(paths):
        p.rename(tmp_path / "flat" / f"{i}.parquet")
    stream = spark.readStream.schema("task_id string, status string, beat timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    found = []
    rules.stale_tasks(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(df.collect())).start().awaitTermination()
    assert [(r.task_id, r.status) for r in found] == [("a", "stale")]


def test_dispatch_and_outbox(spark):
    rows = spark.createDataFrame([("1", "ok", 0), ("2", "bad", 0), ("3", "bad", 2), ("4", "boom", 0)], "id string, payload string, attempts int")

    def send(payload):
        if payload == "boom":
            raise OSError
        return payload == "ok"

    got = {r.id: (r.status, r.attempts, r.delay_seconds) for r in rules.dispatched(rows, send).collect()}
    assert got == {"1": ("sent", 1, 0), "2": ("pending", 1, 30), "3": ("failed", 3, 0), "4": ("pending", 1, 30)}
    now = dt.datetime(2024, 1, 1)
    box = spark.createDataFrame([(1, "pending", None, now), (2, "pending", now + dt.timedelta(1), now), (3, "sent", None, now), (4, "pending", now, now - dt.timedelta(1))], "id int, status string, available_at timestamp, created_at timestamp")
    assert [r.id for r in control.due(box, F.lit(now)).collect()] == [4, 1]


def test_cache_and_migration(spark):
    key = dict(zip(tables.CACHE_KEYS, ("p", "s", "x", "m", 2, "v1")))
    cache = spark.createDataFrame([key | {"id": i, "updated_at": i, "embedding": [float(i)]} for i in range(3)])
    wanted = spark.createDataFrame([key, key | {"sha": "other"}])
    assert sorted((r.sha, r.embedding) for r in tables.cached(wanted, cache).collect()) == [("other", None), ("s", [2.0])]
    listing = spark.createDataFrame([("a1", "a"), ("a0", "a"), ("b", "b")], "path string, key string")
    assert [r.path for r in tables.copied(listing, spark.createDataFrame([("b",)], "key string")).collect()] == ["a0"]


def test_candidates_of_themes(spark):
    given = spark.createDataFrame([("x", 1, " Beach "), ("x", 2, "beach"), ("y", 1, "")], "album_id string, nth int, title string")
    presets = spark.createDataFrame([(1, "旅行见闻"), (2, "亲友相聚"), (3, "日常片段")], "nth int, title string")
    got = sorted(map(tuple, theme.merged_candidates(given, presets).collect()))
    assert got == [("x", 1, "Beach"), ("x", 2, "旅行见闻"), ("x", 3, "亲友相聚"), ("y", 1, "旅行见闻"), ("y", 2, "亲友相聚"), ("y", 3, "日常片段")]


def test_queue_asks_once(spark):
    photos = spark.createDataFrame([("x", i, None, "review", ["closed_eyes_suspected"] if i == 1 else None) for i in range(3)], "album_id string, photo_id int, decision string, suggestion string, issues array<string>")
    groups = spark.createDataFrame([("x", 1, "burst", 0.9, 0)], "album_id string, group_id int, group_type string, confidence double, preferred int")
    members = spark.createDataFrame([("x", 1, 0, 1), ("x", 1, 1, 2)], "album_id string, group_id int, photo_id int, rank int")
    got = {r.item: r for r in review.queue(photos, groups, members).collect()}
    assert sorted(got) == ["group:1", "photo:2"] and got["group:1"].photo_ids == [0, 1] and got["group:1"].reasons == ["closed_eyes_suspected", "duplicate_burst"]
    assert got["group:1"].priority == 80 and got["group:1"].action == "accept_preferred"
    assert sorted((r.photo_id, r.decision) for r in review.accept_preferred(groups, members).collect()) == [(0, "keep"), (1, "remove")]
    stored = spark.createDataFrame([("x", 0, "remove", "user"), ("x", 1, None, None)], "album_id string, photo_id int, decision string, source string")
    assert [r.photo_id for r in review.changes(stored, review.accept_preferred(groups, members), keep_user=True).collect()] == [1]
