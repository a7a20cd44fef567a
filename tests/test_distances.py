"""Scales, sums of distances and mean similarities by blocks, against all pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import distances, representatives, timeline

PHOTO = "album_id string, photo_id long, taken_at timestamp, lat double, lon double, embedding array<double>, histogram array<double>, tags array<string>"


def plain_scale(x):
    x = np.asarray(x, float)
    x = x[x > 0]
    if not len(x):
        return 1.0
    q = np.percentile(x, [25, 50, 75])
    return max(q[2] - q[0], q[1], 1e-9)


def album(rng, name, n, first=0):
    at = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    rows = []
    for i in range(n):
        there = rng.random() < 0.8
        rows.append((
            name, first + i, at + dt.timedelta(seconds=int(rng.integers(0, 50_000))) if rng.random() < 0.8 else None, float(rng.integers(-80, 80)) / 4 if there else None, float(rng.integers(0, 90)) / 2 if there else None,
            [float(v) for v in rng.normal(size=3 if rng.random() < 0.7 else 5)] if rng.random() < 0.7 else None, [float(v) for v in rng.random(6)] if rng.random() < 0.7 else None, [str(t) for t in rng.choice(list("abcde"), int(rng.integers(0, 4)))],
        ))
    return rows


@pytest.fixture(scope="module")
def photos(spark):
    rng = np.random.default_rng(11)
    rows = album(rng, "large", 60) + album(rng, "small", 7, 100) + album(rng, "one", 1, 200) + [("same", 300 + i, None, 10.0, 20.0, None, None, None) for i in range(30)]
    return rows, spark.createDataFrame(rows, PHOTO).cache()


def kilometres(p, q):
    a, b, c, d = map(np.radians, (p[3], p[4], q[3], q[4]))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(min(1, np.sqrt(h)))


def plain_scales(rows):
    seconds = [abs((p[2] - q[2]).total_seconds()) for i, p in enumerate(rows) for q in rows[:i] if p[2] and q[2]]
    km = [kilometres(p, q) for i, p in enumerate(rows) for q in rows[:i] if p[3] is not None and q[3] is not None]
    return plain_scale(seconds), plain_scale(km)


def plain_distance(p, q, weights, scales):
    parts = []
    if p[5] and q[5] and len(p[5]) == len(q[5]):
        a, b = (np.array(v) / np.linalg.norm(v) for v in (p[5], q[5]))
        parts.append((weights["embedding"], np.clip((1 - a @ b) / 2, 0, 1)))
    if p[2] and q[2]:
        gap = abs((p[2] - q[2]).total_seconds())
        parts.append((weights["time"], gap / (gap + scales[0])))
    if p[3] is not None and q[3] is not None:
        gap = kilometres(p, q)
        parts.append((weights["gps"], gap / (gap + scales[1])))
    if p[6] and q[6]:
        a, b = (np.sqrt(np.array(v) / sum(v)) for v in (p[6], q[6]))
        parts.append((weights["color"], np.linalg.norm(a - b) / np.sqrt(2)))
    total = sum(w for w, _ in parts)
    return min(1.0, max(0.0, sum(w * d for w, d in parts) / total)) if total else 1.0


def by_album(rows):
    return {name: [r for r in rows if r[0] == name] for name in dict.fromkeys(r[0] for r in rows)}


@pytest.mark.parametrize("size", [512, 9])
def test_scales_equal_those_of_all_pairs(spark, photos, size):
    rows, df = photos
    got = {r.album_id: (r.time_scale, r.gps_scale) for r in distances.scales(df, size).collect()}
    assert set(got) == set(by_album(rows))
    for name, part in by_album(rows).items():
        assert got[name] == pytest.approx(plain_scales(part), rel=1e-9)


@pytest.mark.parametrize("size", [512, 9])
def test_sums_by_label_equal_those_of_all_pairs(spark, photos, size):
    rows, df = photos
    weights = timeline.STRATEGIES["balanced"]
    labels = df.select("album_id", "photo_id", F.when(F.col("photo_id") % 3 > 0, F.col("photo_id") % 3).otherwise(0).cast("int").alias("label"))
    sums = distances.label_sums(df, labels, weights, size)
    got = {(r.photo_id, r.other): r.total for r in sums.collect()}
    spread = {r.album_id: r.dispersion for r in timeline.dispersion(sums, labels).collect()}
    shape = {r.photo_id: r.silhouette for r in timeline.silhouette(sums, labels).collect()}
    for name, part in by_album(rows).items():
        scales, groups = plain_scales(part), {k: [r for r in part if r[1] % 3 == k] for k in range(3)}
        total = 0.0
        for p in part:
            d = {k: [plain_distance(p, q, weights, scales) for q in g if q is not p] for k, g in groups.items() if g}
            for k, x in d.items():
                assert got.pop((p[1], k)) == pytest.approx(sum(x), abs=1e-6)
            total += sum(d[p[1] % 3]) / len(groups[p[1] % 3]) / 2
            inner, outer = np.mean(d[p[1] % 3]) if d[p[1] % 3] else None, [np.mean(x) for k, x in d.items() if k != p[1] % 3]
            want = (min(outer) - inner) / max(min(outer), inner) if outer and inner is not None and max(min(outer), inner) > 0 else 0.0
            assert shape[p[1]] == pytest.approx(want, abs=1e-6)
        assert spread[name] == pytest.approx(max(total, 1e-12), abs=1e-6)
    assert not got


@pytest.mark.parametrize("size", [512, 9])
def test_mean_similarity_equals_that_of_all_pairs(spark, photos, size):
    rows, df = photos
    got = {r.photo_id: r.mean for r in distances.mean_similarity(df, "album_id", size=size).collect()}

    def like(p, q):
        if p[5] and q[5] and len(p[5]) == len(q[5]):
            return float(np.clip((np.dot(p[5], q[5]) - 0.2) / 0.75, 0, 1))
        parts = []
        a, b = set(p[7] or ()), set(q[7] or ())
        if a and b:
            parts.append((0.75, len(a & b) / len(a | b)))
        if p[6] and q[6]:
            parts.append((0.25, np.minimum(p[6], q[6]).sum() / 3))
        return sum(w * s for w, s in parts) / sum(w for w, _ in parts) if parts else None

    for part in by_album(rows).values():
        for p in part:
            seen = [s for q in part if q is not p and (s := like(p, q)) is not None]
            assert got[p[1]] == (pytest.approx(np.mean(seen), abs=1e-9) if seen else None)
    plan = representatives.typicality(df, "album_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" in plan and len(got) == len(rows)


def test_orders_of_differences():
    rng = np.random.default_rng(3)
    for n in (2, 3, 10, 200):
        x = rng.integers(0, 3 * n, n) * 1000
        values, counts = np.unique(x, return_counts=True)
        every = np.sort(np.abs(x[:, None] - x[None, :])[np.triu_indices(n, 1)])
        every = every[every > 0]
        if len(every):
            assert distances.pair_order(values, counts, np.arange(len(every))).tolist() == every.tolist()


def test_time_scale_of_a_large_album(spark):
    """50,000 photos have 1.25 billion pairs; the quartiles found have the right numbers of pairs below and up to them."""
    n = 50_000
    df = spark.range(n).select(F.lit("a").alias("album_id"), F.timestamp_micros(F.lit(10**15) + F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("long")).alias("taken_at"))
    got = distances.time_scales(df).first().time_scale
    t = np.sort(np.array([r[0] for r in df.select(F.unix_micros("taken_at")).collect()]))
    upto = lambda x: int((np.searchsorted(t, t + x, "right") - np.arange(1, n + 1)).sum())
    ranks, place = distances.interpolated(n * (n - 1) // 2)
    found = distances.pair_order(t, np.ones(n, np.int64), ranks)
    for rank, x in zip(ranks, found, strict=True):
        assert upto(int(x) - 1) <= rank < upto(int(x))
    assert got == pytest.approx(distances.scale_of(found / 1e6, place))


def test_untimed_photos_meet_few_histograms(spark):
    """40 events of 20 members whose histograms are alike within an event: bounds leave a few events open for each of 60 photos, and the outcome is that of all pairs."""
    rng = np.random.default_rng(8)
    base = rng.random((40, 12)) ** 4

    def make(e):
        h = base[e] * rng.uniform(0.97, 1.03, 12)
        return [float(x) for x in h / h.sum()]

    members = [("a", 1000 + 20 * e + i, e, None, None, [f"t{e % 9}"] if e % 3 else [], make(e)) for e in range(40) for i in range(20)]
    untimed = [("a", i, None, None, [f"t{i % 9}"] if i % 2 else None, make(int(rng.integers(40)))) for i in range(60)] + [("a", 900, None, None, None, None), ("a", 901, 1.0, 2.0, None, [0.5, 0.5])]
    events = spark.createDataFrame(members, "album_id string, photo_id long, event int, lat double, lon double, tags array<string>, histogram array<double>")
    photos = spark.createDataFrame(untimed, "album_id string, photo_id long, lat double, lon double, tags array<string>, histogram array<double>")
    near = timeline.bounded_profiles(photos, events)
    met = near.where("open").join(events, ["album_id", "event"]).count()
    assert met < 60 * len(members) / 8
    got = {r.photo_id: (r.event, r.profile) for r in timeline.assign_untimed(photos, events).collect()}
    for _, i, _, _, tags, h in untimed:
        best = {}
        for m in members:
            parts = []
            if tags and m[5]:
                parts.append((0.35, len(set(tags) & set(m[5])) / len(set(tags) | set(m[5]))))
            if h and len(h) == len(m[6]):
                parts.append((0.20, float(np.minimum(h, m[6]).sum()) / 3))
            for w, x in parts:
                best.setdefault(m[2], {}).setdefault(w, []).append(x)
        profile = {e: sum(w * max(x) for w, x in c.items()) / sum(c) for e, c in best.items()}
        ranked = sorted(profile.items(), key=lambda p: (-p[1], p[0]))
        if not ranked:
            assert got[i] == (None, None)
            continue
        after = ranked[1][1] if len(ranked) > 1 else 0
        assert got[i][1] == pytest.approx(ranked[0][1], abs=1e-9)
        if abs(ranked[0][1] - after - 0.15) > 1e-6 and abs(ranked[0][1] - 0.6) > 1e-6:
            assert got[i][0] == (ranked[0][0] if ranked[0][1] >= 0.6 and ranked[0][1] - after >= 0.15 else None)


def test_time_scales_of_albums_of_many_blocks(spark, monkeypatch):
    """Albums larger than a task are counted block by block, and the scales are those of whole albums."""
    rng = np.random.default_rng(5)
    rows = [(a, int(t)) for a, n, most in (("a", 900, 10**9), ("b", 400, 700), ("c", 30, 10**6), ("d", 300, 10**12)) for t in np.concatenate([rng.integers(0, most, n), rng.integers(0, most // 90 + 1, n)])]
    df = spark.createDataFrame(rows, "album_id string, at long").select("album_id", F.timestamp_micros("at").alias("taken_at"))
    whole = {r.album_id: r.time_scale for r in distances.time_scales(df).collect()}
    seen, kept = [], distances._spread_orders
    monkeypatch.setattr(distances, "_spread_orders", lambda ranges, kind: seen.append(max(r["count"] for r in ranges.groupBy("block").count().collect())) or kept(ranges, kind))
    assert {r.album_id: r.time_scale for r in distances.time_scales(df, 100).collect()} == whole and len(whole) == 4
    assert seen and seen[0] < 400
