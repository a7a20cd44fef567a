import datetime as dt

import numpy as np
import pytest

from darkroom.operators import control, duplicates, evaluation, graphs, timeline
from darkroom.plans import timelines
from darkroom.sources import manifests, media, tables
from darkroom.streaming import rules


def photos(spark, rows):
    made = [{"album_id": "a", "photo_id": str(i), "sha": r.get("sha"), "phash": r.get("phash"), "histogram": [0.1] * 48, "aspect": 1.5, "taken_at": None, "device": None} for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "album_id string, photo_id string, sha string, phash string, histogram array<double>, aspect double, taken_at timestamp, device string")


def groups(spark, rows):
    p = photos(spark, rows)
    found = duplicates.complete_link(p, duplicates.relations(duplicates.candidates(p), p))
    out = {}
    for r in found.collect():
        out.setdefault(r.group_id, set()).add(r.photo_id)
    return sorted(map(sorted, out.values()))


def test_chain_is_not_merged(spark):
    assert groups(spark, [{"phash": "0" * 16}, {"phash": "0" * 14 + "0f"}, {"phash": "0" * 14 + "ff"}]) == [["0", "1"]]


def test_copies_start_together(spark):
    assert groups(spark, [{"sha": "x", "phash": "0"}, {"sha": "x", "phash": "0"}, {"sha": "y", "phash": "1"}, {"sha": None, "phash": None}]) == [["0", "1", "2"]]


def plain_groups(ids, sha, edges, most):
    """Complete-link groups by plain sets, link by link."""
    groups = {}
    for i in ids:
        groups.setdefault(("sha", sha[i]) if sha[i] else i, set()).add(i)
    of = {i: g for g in groups.values() for i in g}
    related = {(a, b) for _, _, a, b in edges}
    for _, _, a, b in sorted(edges):
        x, y = of[a], of[b]
        if x is not y and len(x) + len(y) <= most and all((min(i, j), max(i, j)) in related for i in x for j in y):
            x |= y
            of |= dict.fromkeys(y, x)
    return {i: min(g) for i, g in of.items() if len(g) > 1}


@pytest.mark.parametrize("block, shape", [(10**6, "random"), (40, "random"), (25, "chain"), (30, "copies"), (60, "clusters")])
def test_groups_of_albums_larger_than_a_task(spark, block, shape):
    """Albums whose related pairs outnumber `block` go by components, then by ranges of photos: the groups are those of plain sets."""
    rng = np.random.default_rng(len(shape) + block % 97)
    rows, pairs, want = [], [], {}
    for album, n in (("large", 160), ("small", 12), ("none", 3)):
        ids = [int(i) for i in rng.permutation(5 * n)[:n]]
        order = sorted(ids)
        sha = {i: f"c{k % max(2, n // 4)}" if shape == "copies" and k % 3 else None for k, i in enumerate(ids)}
        edges = set()
        for k, i in enumerate(order):
            for step in range(1, 9 if shape in ("chain", "clusters") else 4):
                if shape == "chain":
                    other = order[k + step] if k + step < n and step <= 3 else None
                elif shape == "clusters":
                    other = order[k + step] if k + step < n and (k // 9 == (k + step) // 9 or rng.random() < 0.1) else None
                else:
                    other = order[int(rng.integers(n))]
                if other is not None and other != i and not (sha[i] and sha[i] == sha[other]) and album != "none":
                    edges.add((min(i, other), max(i, other)))
        edges = [(int(rng.integers(1, 3)), int(rng.integers(0, 4)), a, b) for a, b in sorted(edges)]
        want |= {(album, i): g for i, g in plain_groups(ids, sha, edges, 8).items()}
        rows += [(album, i, sha[i]) for i in ids]
        pairs += [(album, a, b, {1: "near", 2: "burst"}[kind], distance) for kind, distance, a, b in edges]
    photos = spark.createDataFrame(rows, "album_id string, photo_id long, sha string")
    related = spark.createDataFrame(pairs, "album_id string, a long, b long, relation string, hamming int")
    got = duplicates.complete_link(photos, related, 8, block).collect()
    assert len(got) == len({(r.album_id, r.photo_id) for r in got})
    assert {(r.album_id, r.photo_id): r.group_id for r in got} == want


def test_components_follow_long_chains(spark):
    links = [("x", i, i + 1) for i in range(300)] + [("x", 1000 - i, 1001 - i) for i in range(200)] + [("y", 5, 7), ("y", 7, 7), ("y", 9, 8)]
    got = {(r.k, r.node): r.component for r in graphs.components(spark.createDataFrame(links, "k string, a long, b long"), ["k"]).collect()}
    want = {("x", i): 0 for i in range(301)} | {("x", i): 801 for i in range(801, 1002)} | {("y", 5): 5, ("y", 7): 5, ("y", 8): 8, ("y", 9): 8}
    assert got == want
    assert graphs.components(spark.createDataFrame([], "k string, a long, b long"), ["k"]).count() == 0


def test_candidates_are_linear(spark):
    n = 2000
    p = photos(spark, [{"phash": f"{i:x}"} for i in range(n)])
    pairs = duplicates.candidates(p)
    assert pairs.count() <= n * 13 * duplicates.NEIGHBOURS
    assert pairs.where("a = b").count() == 0


def test_histogram_of_zero_is_reviewed(spark):
    row = {"album_id": 1, "group_id": 1, "photo_id": 2, "rank": 2, "exact_rank": 1, "relation": "near", "hamming": 2, "histogram_distance": 0.0, "hard_reject": False, "confidence": 0.1}
    got = duplicates.decided(spark.createDataFrame([row, row | {"histogram_distance": 0.05}])).select("suggestion", "confidence").collect()
    assert [tuple(r) for r in got] == [("review", 0.75), ("remove", 0.9)]


def test_partitions_match_brute_force():
    rng = np.random.default_rng(1)
    x = rng.random((7, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    costs = {(a, b): d[a:b, a:b].sum() / (2 * (b - a)) for a in range(7) for b in range(a + 1, 8)}
    found, start = timeline.partitioned(d, 4)
    for k in range(1, 5):
        labels = timeline.labels_of(start, k)
        from itertools import combinations

        best = min(sum(costs[a, b] for a, b in zip((0, *c), (*c, 7))) for c in combinations(range(1, 7), k - 1))
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), 7]
        assert sum(costs[a, b] for a, b in zip(cuts, cuts[1:])) == pytest.approx(best)
        assert found[k - 1] == pytest.approx(max(best, 1e-12))


def sequence(spark, groups=6, each=4, reverse=False):
    rows = []
    for g in range(groups):
        for i in range(each):
            v = [0.0] * (groups + 1)
            v[g], v[-1] = 1.0, 0.02 * i
            rows.append(("a", f"{g}{i}", dt.datetime(2026, 7, 17, 10) + dt.timedelta(minutes=3 * (g * each + i)), None, None, v, None))
    return spark.createDataFrame(rows[::-1] if reverse else rows, "album_id string, photo_id string, taken_at timestamp, lat double, lon double, embedding array<double>, histogram array<double>")


def test_sequential_finds_activities(spark):
    got = {r.photo_id: r.chapter for r in timeline.sequential(sequence(spark), "activity_first", references=4, runs=4).collect()}
    assert len(set(got.values())) == 6 and all(got[f"{g}{i}"] == g + 1 for g in range(6) for i in range(4))
    again = {r.photo_id: r.chapter for r in timeline.sequential(sequence(spark, reverse=True), "activity_first", references=4, runs=4).collect()}
    assert got == again


def test_segments_cut_chapters_into_activities(spark):
    rows = sequence(spark, each=6).unionByName(sequence(spark, each=6).where("photo_id = '00'").selectExpr("album_id", "'late' AS photo_id", "CAST(NULL AS TIMESTAMP) AS taken_at", "lat", "lon", "embedding", "histogram"))
    got = {r.photo_id: r for r in timeline.sequential(rows, "activity_first", granularity=-2).collect()}
    assert len(got) == 37 and got["late"].chapters == 4 and got["late"].chapter == got["00"].chapter and got["late"].segment >= 1
    timed = [got[f"{g}{i}"] for g in range(6) for i in range(6)]
    whole = [g for g in range(6) if len({(got[f"{g}{i}"].chapter, got[f"{g}{i}"].segment) for i in range(6)}) == 1]
    assert whole == list(range(6))
    assert len({(r.chapter, r.segment) for r in timed}) == 6
    for chapter in range(1, 5):
        parts = [r.segment for r in timed if r.chapter == chapter]
        assert parts == sorted(parts) and set(parts) == set(range(1, parts[-1] + 1))
    assert all(r.segments >= r.segment and 0 <= r.segment_quality <= 1 and r.segment_k_stability * 5 == round(r.segment_k_stability * 5) for r in got.values())


def test_large_albums_are_dealt_by_reference(spark):
    """Equal results, whether one task or one for each reference finds the references' costs."""
    key = lambda df: sorted((r.photo_id, r.chapter, r.segment, r.quality, r.k_stability) for r in df.collect())
    assert key(timeline.sequential(sequence(spark), "balanced", references=3, runs=3, large=10)) == key(timeline.sequential(sequence(spark), "balanced", references=3, runs=3))


def test_distances_of_large_albums_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    n = 1200
    data = (np.sort(rng.random(n)) * 1e6, rng.standard_normal((n, 16)), rng.random(n) * 10, rng.random(n) * 10, rng.random((n, 48)))
    tracemalloc.start()
    costs = timeline.reference_costs(data, timeline.shaken_weights(timeline.STRATEGIES["balanced"], 1, 1), 5, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert costs.shape == (2, 36) and peak < 40 * n * n
    # single and double precision agree
    small = tuple(x[:400] for x in data)
    double = timeline.matrix(timeline.channels(*small), timeline.STRATEGIES["balanced"])
    assert double.dtype == np.float64 and timeline.matrix(timeline.channels(*data), timeline.STRATEGIES["balanced"]).dtype == np.float32
    for i, j in ((0, 1), (5, 300), (17, 17)):
        c = timeline.channels(*small)
        km = c["gps"][i, j] / (1 - c["gps"][i, j])
        assert c["time"][i, j] == c["time"][j, i] and km >= 0 and double[i, j] == double[j, i]


def test_photos_without_time_join_the_nearest():
    """Vectorised distances of a photo to others against those of each two photos alone."""
    rng = np.random.default_rng(4)
    n = 9
    e = rng.standard_normal((n, 5))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = rng.random((n, 6))
    c /= c.sum(1, keepdims=True)
    lat, lon = rng.random(n) * 10, rng.random(n) * 10
    lat[2], lat[5], lon[5], e[3], c[4] = np.nan, lat[8], lon[8], np.nan, np.nan
    place = (np.full(n, np.nan), e, lat, lon, c)
    got = timeline._beside(8, np.arange(8), place, timeline.STRATEGIES["balanced"])
    for m in range(8):
        alone = timeline.matrix(timeline.channels(np.full(2, np.nan), *(x[[8, m]] for x in place[1:])), timeline.STRATEGIES["balanced"])[0, 1]
        assert got[m] == pytest.approx(alone, abs=1e-9)


def test_chapters_use_all_references_and_runs(spark, monkeypatch):
    used = []
    monkeypatch.setattr(timeline, "sequential", lambda photos, strategy="balanced", granularity=0, references=20, runs=20: used.append((strategy, granularity, references, runs)))
    timelines.sequential_chapters(spark, "/root/testdata/sf0.001")
    assert used == [("balanced", 0, 20, 20)]


def test_chosen_k(spark):
    rows = [("a", k, g, 0.01) for k, g in enumerate([0.1, 0.2, 0.3, 0.35, 0.36, 0.37, 0.5, 0.49, 0.505], 1)]
    got = timeline.chosen_k(spark.createDataFrame(rows, "album_id string, k int, gap double, error double")).first()
    assert (got.selected, got.peak) == (7, 9)


def test_isotonic_and_logistic(spark):
    rows = spark.createDataFrame([(i / 10, float(i % 3 == 0 or i > 6)) for i in range(12)], "x double, y double")
    xs, ys = evaluation.isotonic(rows, "x", "y")
    assert xs == sorted(xs) and ys == sorted(ys) and 0 <= ys[0] <= ys[-1] <= 1
    fit = evaluation.logistic_fit(rows, ["x"], "y")
    assert fit["weights"][0] > 0
    # a constant feature has the least scale, and numbers ten places
    flat = evaluation.logistic_fit(rows.selectExpr("x", "1.5 AS c", "y"), ["x", "c"], "y")
    assert flat["scale"][1] == 1e-6 and flat["weights"][1] == 0 and flat["mean"][1] == 1.5 and all(round(w, 10) == w for w in flat["weights"])
    # pooling by ranges and then over them equals pooling at once
    rng = np.random.default_rng(3)
    blocks = [[float(i), float(i), 1.0, float(v)] for i, v in enumerate(rng.random(60) + np.arange(60) / 40)]
    by_range = [b for part in (blocks[:17], blocks[17:40], blocks[40:]) for b in evaluation._pooled(part)]
    assert np.allclose(evaluation._pooled(by_range), evaluation._pooled(blocks))


def test_precedence_and_codes(spark):
    scopes = spark.createDataFrame([("p", "s", 1, "exact"), ("p", None, 1, "project"), (None, "t", 1, "stage"), (None, None, 1, "default")], "project string, stage string, priority int, value string")
    wanted = spark.createDataFrame([("p", "s"), ("p", "x"), ("q", "t"), ("q", "x")], "project string, stage string")
    got = {(r.project, r.stage): r.value for r in control.setting(scopes, wanted).collect()}
    assert got == {("p", "s"): "exact", ("p", "x"): "project", ("q", "t"): "stage", ("q", "x"): "default"}


def test_manifests_and_replacement(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"photo_id": "1", "expected_chapter": "x", "predicted_chapter": "y"}]')
    (tmp_path / "b.json").write_text('{"items": [{"photo_id": "2", "expected_chapter": "x", "predicted_chapter": "x"}, {"photo_id": "3"}]}')
    assert [r.photo_id for r in manifests.items(spark, str(tmp_path / "a.json"), manifests.CHAPTERS).collect()] == ["1"]
    assert [r.photo_id for r in manifests.items(spark, str(tmp_path / "b.json"), manifests.CHAPTERS).collect()] == ["2", "3"]
    path = str(tmp_path / "t")
    tables.replace_albums(spark.createDataFrame([("a", 1), ("b", 2)], "album_id string, n int"), path)
    tables.replace_albums(spark.createDataFrame([("a", 7)], "album_id string, n int"), path)
    assert sorted((r.album_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]


def test_media(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + bytes(12)
    for name, data in (("a.png", png), ("b.jpg", jpg), ("c.txt", b"no"), ("d.gif", b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little")), ("e.bmp", b"BM" + bytes(16) + (7).to_bytes(4, "little") + (8).to_bytes(4, "little"))):
        (tmp_path / name).write_bytes(data)
    from pyspark.sql import functions as F

    rows = media.checked(media.with_sizes(media.files(spark, str(tmp_path))).withColumn("batch", F.lit(1)), "batch")
    got = {r.path[-5:]: (r.width, r.height, r.reason) for r in rows.collect()}
    assert got == {"a.png": (640, 480, None), "b.jpg": (400, 300, None), "c.txt": (None, None, "unsupported_type"), "d.gif": (5, 6, None), "e.bmp": (7, 8, None)}


def test_streams_equal_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(seconds=10 * i)) for i in range(8)] + [(2, base + dt.timedelta(minutes=20 * i)) for i in range(8)] + [(9, base + dt.timedelta(days=3))]
    spark.createDataFrame(rows, "user_id int, ts timestamp").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for n, (make, keys) in enumerate(((lambda e: rules.rate_limited(e, "user_id", "ts", 3), ("user_id", "start", "requests")), (lambda e: rules.lockouts(e, "user_id", "ts"), ("user_id", "start", "failures")))):
        out = str(tmp_path / f"out{n}")
        make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{n}")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        read = lambda df: sorted(tuple(r[k] for k in keys) for r in df.collect())
        assert read(spark.read.parquet(out)) == read(make(batch)) != []


def test_gates_and_preferred(spark):
    rates = spark.createDataFrame([("duplicate_precision", 0.97, 1.0), ("false_removal_rate", 0.004, 0.01), ("resize_consistency", 1.0, 1.0), ("high_quality_retention", 0.1, 0.2)], "measure string, rate double, high double")
    assert {r.measure: r.passed for r in evaluation.gates(rates).collect()} == {"duplicate_precision": False, "false_removal_rate": False, "resize_consistency": True, "high_quality_retention": True}
    truth = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("y", 3, False), ("y", 4, True), ("z", 5, None), ("z", 6, None), ("w", 7, True)], "cluster string, photo_id int, acceptable boolean")
    predicted = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 3, 3), (2, 4, 3), (3, 5, 5), (3, 6, 5)], "group_id int, photo_id int, preferred int")
    got = evaluation.preferred_accuracy(predicted, truth).first()
    assert (got.groups, got.right) == (2, 1)


def test_pairs_of_keys_are_counted(spark):
    from pyspark.sql import functions as F

    rows = [(i, i % 4, "a" if i % 3 else None, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, lang string, sha int")
    pairs = lambda *c: {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and all(x[i] is not None and x[i] == y[i] for i in c)}
    p, t = pairs(1, 2), pairs(3)
    got = evaluation.key_pair_scores(df, ["n", "lang"], ["sha"]).first()
    assert tuple(got) == (len(p & t), len(p), len(t), len(p & t) / len(p), len(p & t) / len(t))
    assert tuple(evaluation.key_pair_scores(df.limit(0), ["n", "lang"], ["sha"]).first()) == (0, 0, 0, 1.0, 1.0)
    # 2e12 pairs of one key
    n = 2_000_000
    one = spark.range(n).select(F.lit(1).alias("n"), F.lit("a").alias("lang"), (F.col("id") % 2).alias("sha"))
    got = evaluation.key_pair_scores(one, ["n", "lang"], ["sha"]).first()
    assert got.predicted == n * (n - 1) // 2 and got.common == got.true == 2 * (n // 2 * (n // 2 - 1) // 2) and got.recall == 1.0
