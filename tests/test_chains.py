"""Chains of merges and owners, active tasks as table and stream, markup, tiles of photos, isotonic levels."""

import datetime as dt
import html.parser
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.functions import markup
from darkroom.operators import evaluation, faces, graphs, layout, lifecycle
from darkroom.streaming import rules


def test_chains_end_where_pointers_lead(spark):
    rng = random.Random(6)
    step = {i: i + 1 for i in range(0, 130)} | {200: 201, 201: 202, 202: 200, 203: 202, 204: 203, 300: 300, 400: 130}
    step |= {1000 + i: rng.choice([j for j in range(1000, 1060) if j != 1000 + i]) for i in range(50)}
    rows = [("x", a, b) for a, b in step.items()] + [("x", 0, 77), ("y", 0, 5), ("x", None, 3), ("x", 3, None)]
    got = {(r.k, r.node): r.end for r in graphs.followed(spark.createDataFrame(rows, "k string, source long, target long"), ["k"]).collect()}
    want = {}
    for a in step:
        if step[a] == a:
            continue
        way, now = [], a
        while now in step and step[now] != now and now not in way:
            way.append(now)
            now = step[now]
        want["x", a] = min(way[way.index(now) :]) if now in way else now
    assert got == want | {("y", 0): 5}


def test_merges_into_merged_chapters(spark):
    now = spark.createDataFrame([(c, c * 10 + p, p) for c in range(1, 8) for p in range(2)], "chapter int, photo_id int, place int")
    merges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (7, 6), (6, 7)], "source int, target int")
    got = [(r.chapter, r.photo_id, r.place) for r in layout.merged(now, merges).orderBy("chapter", "place").collect()]
    assert got == [(1, c * 10 + p, (c - 1) * 2 + p) for c in range(1, 6) for p in range(2)] + [(6, 60, 0), (6, 61, 1), (6, 70, 2), (6, 71, 3)]


def test_deletion_follows_owners(spark):
    owns = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "b"), ("a", "c"), ("x", "y"), ("a", None)], "owner string, owned string")
    files = spark.createDataFrame([(n, f"{n}/{i}") for n in "abcdexy" for i in range(2)] + [("a", None), ("e", "e/0")], "node string, path string")
    start = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(map(tuple, graphs.reached(start, owns, []).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert sorted(r.path for r in lifecycle.owned_keys(start, owns, files).collect()) == [f"{n}/{i}" for n in "abcde" for i in range(2)]


EVENTS = "album_id string, at timestamp, kind string, task_id string, idempotency string, holds boolean"


def requests():
    rng, at, rows = random.Random(9), dt.datetime(2026, 1, 1), []
    for n in range(240):
        at += dt.timedelta(seconds=rng.randrange(0, 90))
        album = rng.choice("abc")
        if rng.random() < 0.35:
            rows.append((album, at, "end", f"t{max(0, n - rng.randrange(1, 9))}", None, None))
        else:
            rows.append((album, at, "request", f"t{n}", rng.choice([None, "i1", "i2", f"i{n}"]), rng.random() < 0.8))
    return rows


def plain_requests(rows, expiry):
    out = []
    for album in "abc":
        live = []
        for _, at, kind, task, idempotency, holds in sorted((r for r in rows if r[0] == album), key=lambda r: (r[1], r[2] != "end", r[3])):
            live = [a for a in live if at - a[3] < expiry]
            if kind == "end":
                live = [a for a in live if a[0] != task]
                continue
            same, held = [a[0] for a in live if idempotency and a[1] == idempotency], [a[0] for a in live if a[2] is not False]
            met = ("existing", same[0]) if same else ("conflict", held[0]) if held else ("created", task)
            if met[0] == "created":
                live.append((task, idempotency, holds, at))
            out.append((album, task, at, *met))
    return sorted(out)


def test_requests_of_a_table_and_of_a_stream_are_decided_alike(spark, tmp_path):
    rows = requests()
    want = plain_requests(rows, dt.timedelta(seconds=600))
    assert {r[3] for r in want} == {"existing", "conflict", "created"}
    batch = rules.task_requests(spark.createDataFrame(rows, EVENTS).repartition(3), "album_id", 600)
    assert sorted(map(tuple, batch.collect())) == want
    # events of a stream come in another order within the delay; a last one lets the watermark pass
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=hash(r[3]) % 200))
    late.append(("z", rows[-1][1] + dt.timedelta(days=1), "end", "t", None, None))
    (tmp_path / "flat").mkdir()
    for i in range(0, len(late), 50):
        spark.createDataFrame(late[i : i + 50], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:04}"))
        next((tmp_path / "in" / f"{i:04}").glob("*.parquet")).rename(tmp_path / "flat" / f"{i:04}.parquet")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    found = []
    rules.task_requests(stream, "album_id", 600).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(df.collect())).start().awaitTermination()
    assert sorted(map(tuple, found)) == want


class Sources(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, attrs))


def test_tokens_read_as_a_parser_reads():
    rng = random.Random(12)
    pieces = ["<img src=a.png>", "<IMG SRC='a.png'>", '<img alt=">" src="a.png"/>', "<img src = a&amp;b >", "<!-- <img src=a.png> -->", "<script>'<img src=a.png>'</script>", "<style>a<b</style>", "text ", "a < b", "&amp;", "<br/>", "</p>", "<!DOCTYPE html>", "<p\nclass=x id>", "<img src>", '<img data-src="a.png">']
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        parser = Sources()
        parser.feed(page)
        parser.close()
        found = list(markup.tokens(page))
        assert "".join(page[t.start : t.end] for t in found) == page
        want = [(tag, [(n, v) for n, v in attrs]) for tag, attrs in parser.found]
        import html as entities

        assert [(t.name, [(n, None if v is None else entities.unescape(v)) for n, v, _, _ in t.attributes]) for t in found if t.kind == "open"] == want
        after = Sources()
        after.feed(markup.rewritten(page, "img", "src", {"a.png": 'new "b".png', "a&b": "c"}))
        after.close()
        swap = {"a.png": 'new "b".png', "a&b": "c"}
        assert after.found == [(tag, [(n, swap.get(v, v) if (tag, n) == ("img", "src") else v) for n, v in attrs]) for tag, attrs in want]


def test_rewriting_leaves_the_rest(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<img src='x'>"), (4, "<img src=\"x"), (5, "<" * 50_000)], "i int, html string")
    out = {r.i: r.h for r in rows.select("i", markup.rewrite_attribute(F.col("html"), "img", "src", F.create_map(F.lit("x"), F.lit("y"))).alias("h")).collect()}
    assert out == {1: None, 2: "", 3: '<p>a<img src="y">', 4: '<img src="y"', 5: "<" * 50_000}
    assert rows.select(markup.rewrite_attribute(F.col("html"), "img", "src", F.lit(None).cast("map<string,string>")).alias("h")).where("h LIKE '%x%'").count() == 2


def test_tiles_and_letterboxes(spark):
    photos = spark.createDataFrame([(1, 2400, 1000), (2, 3001, 1500), (3, 3000, 1500), (4, 2500, 0)], "photo_id int, width int, height int")
    box = lambda w, h: (0.1, 0.1, w, h)
    found = spark.createDataFrame([(2, 1, 0.9, box(0.01, 0.01)), (3, 1, 0.9, box(0.05, 0.064))], f"photo_id int, face int, score double, box {faces.BOX}")
    got = sorted((r.photo_id, r.left, r.top, r.tile_width, r.tile_height) for r in faces.tiles(photos, found).collect())
    assert got == [(2, x, y, 1801, 900) for x in (0, 1200) for y in (0, 600)] + [(4, 0, 0, 1500, 0), (4, 1000, 0, 1500, 0)]
    raw = spark.createDataFrame([(1, 1, 0.9, 0.25, 0.5, 0.5, 0.75, 832, 416), (1, 2, 0.69, 0.0, 0.0, 1.0, 1.0, 832, 416), (1, 3, 0.8, -50.0, 104.0, 208.0, 500.0, 832, 416), (1, 4, 0.8, 10.0, 0.0, 20.0, 50.0, 832, 416)], "photo_id int, face int, score double, x1 double, y1 double, x2 double, y2 double, width int, height int")
    out = {r.face: tuple(r.box) for r in faces.from_letterbox(raw).collect()}
    assert set(out) == {1, 3} and out[1] == pytest.approx((0.25, 0.5, 0.25, 0.5)) and out[3] == pytest.approx((0.0, 0.0, 0.5, 1.0))


def test_equal_levels_are_one(spark):
    rows = spark.range(4000).select(F.col("id").alias("x"), F.when(F.col("id") < 2000, F.col("id") % 2).otherwise(F.when(F.col("id") % 4 > 0, 1).otherwise(0)).alias("y"))
    xs, ys = evaluation.isotonic(rows, "x", "y")
    assert len(xs) <= 12 and ys == sorted(ys)
    fit = np.interp([500, 3000], xs, ys)
    assert fit[0] == pytest.approx(0.5, abs=0.01) and fit[1] == pytest.approx(0.75, abs=0.01)


def test_sweeps_of_scores_outside_the_unit_interval(spark):
    rows = spark.range(500).select((F.col("id") * 3.0 - 700).alias("s"), (F.col("id") % 2).cast("boolean").alias("m"))
    got = {r.score: (r.above_m, r.below_m, r.all_m) for r in evaluation._swept(rows, "s", m=F.col("m")).collect()}
    marks = [(i * 3.0 - 700, i % 2) for i in range(500)]
    assert got == {s: (sum(m for t, m in marks if t >= s), sum(m for t, m in marks if t <= s), 250) for s, _ in marks}


def test_links_are_not_sorted_out_in_each_round(spark, monkeypatch):
    """A round makes what it reaches distinct, and nothing else: repeated links do no harm."""
    plans, kept = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    owns = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", None), (None, "d")] * 3, "owner string, owned string")
    start = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(map(tuple, graphs.reached(start, owns, []).collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert len(plans) == 3 and all(p.count("Aggregate") == 1 for p in plans)
