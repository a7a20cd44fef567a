"""Contiguous chapters: distances, partitions, gap statistic, stability and quality against plain loops. Only the random references are the module's own."""

import itertools
import math

import numpy as np
import pytest

from darkroom.operators import timeline


def sequence(rng, n):
    t = np.sort(rng.uniform(0, 9e4, n))
    e = rng.normal(size=(n, 4)) + 3 * (np.arange(n) // 5)[:, None] % 7
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    lat, lon = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n)
    c = rng.random((n, 6))
    c /= c.sum(1, keepdims=True)
    for x in (t, lat, lon):
        x[rng.random(n) < 0.1] = np.nan
    t = np.sort(t)
    lon[np.isnan(lat)] = np.nan
    lat[np.isnan(lon)] = np.nan
    e[rng.random(n) < 0.15], c[rng.random(n) < 0.15] = np.nan, np.nan
    return t, e, lat, lon, c


def scale(x):
    x = sorted(v for v in x if v > 0)
    if not x:
        return 1.0

    def at(q):
        h = q * (len(x) - 1)
        low = math.floor(h)
        return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (h - low)

    return max(at(0.75) - at(0.25), at(0.5), 1e-9)


def plain_channels(t, e, lat, lon, c):
    n = len(t)
    km = lambda i, j: 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin(math.radians(lat[j] - lat[i]) / 2) ** 2 + math.cos(math.radians(lat[i])) * math.cos(math.radians(lat[j])) * math.sin(math.radians(lon[j] - lon[i]) / 2) ** 2)))
    have = {"time": ~np.isnan(t), "gps": ~np.isnan(lat), "embedding": ~np.isnan(e).any(1), "color": ~np.isnan(c).any(1)}
    pairs = list(itertools.combinations(range(n), 2))
    seconds = scale([abs(t[i] - t[j]) for i, j in pairs if have["time"][i] and have["time"][j]])
    metres = scale([km(i, j) for i, j in pairs if have["gps"][i] and have["gps"][j]])
    raw = {
        "time": lambda i, j: abs(t[i] - t[j]) / (abs(t[i] - t[j]) + seconds), "gps": lambda i, j: km(i, j) / (km(i, j) + metres),
        "embedding": lambda i, j: min(1, max(0, (1 - float(e[i] @ e[j])) / 2)), "color": lambda i, j: math.sqrt(sum((math.sqrt(a) - math.sqrt(b)) ** 2 for a, b in zip(c[i], c[j])) / 2),
    }
    return {k: {(i, j): f(i, j) for i, j in pairs if have[k][i] and have[k][j]} for k, f in raw.items()}


def plain_matrix(channels, weights, n):
    d = np.zeros((n, n))
    for i, j in itertools.combinations(range(n), 2):
        parts = [(w, channels[k][i, j]) for k, w in weights.items() if (i, j) in channels[k]]
        d[i, j] = d[j, i] = min(1, max(0, sum(w * x for w, x in parts) / sum(w for w, _ in parts))) if parts else 1.0
    return d


def plain_partitions(d, most):
    """Cost and labels of the best partition into each number of parts, by a table without running sums."""
    n = len(d)
    cost = [[0.0 if b - a == 1 else d[a:b, a:b].sum() / 2 / (b - a) for b in range(a + 1, n + 1)] for a in range(n)]
    best = [{0: (0.0, ())}]
    for _ in range(most):
        best.append({b: min((best[-1][a][0] + cost[a][b - a - 1], (*best[-1][a][1], a)) for a in range(b) if a in best[-1]) for b in range(1, n + 1) if any(a in best[-1] for a in range(b))})
    out = []
    for k in range(1, most + 1):
        value, starts = best[k][n]
        labels = np.zeros(n, int)
        for j, a in enumerate(starts):
            labels[a:] = j
        out.append((max(value, 1e-12), labels))
    return out


def plain_choice(own, refs, granularity):
    gaps, errors = [], []
    for k in range(len(own)):
        logs = [math.log(r[k]) for r in refs]
        mean = sum(logs) / len(logs)
        gaps.append(mean - math.log(own[k]))
        errors.append(math.sqrt(sum((x - mean) ** 2 for x in logs) / (len(logs) - 1)) * math.sqrt(1 + 1 / len(logs)))
    peak = max(range(len(gaps)), key=lambda k: (gaps[k], -k))
    auto = next(k + 1 for k in range(len(gaps)) if gaps[peak] - gaps[k] <= math.sqrt(errors[peak] ** 2 + errors[k] ** 2))
    return auto, min(max(auto + granularity, 1), len(own)), peak + 1


@pytest.mark.parametrize("n, granularity", [(3, 0), (8, 1), (13, 0), (13, -1), (20, 2)])
def test_cuts_equal_plain_loops(n, granularity):
    data = sequence(np.random.default_rng(n + granularity), n)
    weights, references, runs, seed, shaken = timeline.STRATEGIES["balanced"], 4, 3, 12345, 77
    found = timeline.cut(data, weights, granularity, references, runs, seed, shaken)
    channels, most = plain_channels(*data), min(n - 1, math.ceil(math.sqrt(n)) + 1)
    for k, m in timeline.channels(*data).items():
        assert {p for p in itertools.combinations(range(n), 2) if not np.isnan(m[p])} == set(channels[k])
        assert all(m[p] == pytest.approx(x, abs=1e-7) for p, x in channels[k].items())
    every = timeline.shaken_weights(weights, runs, seed ^ shaken)
    assert len(every) == 1 + runs and all(sum(w.values()) == pytest.approx(1) for w in every)
    random = [timeline.reference(*data, np.random.default_rng([seed, r])) for r in range(references)]
    random = [{k: {p: m[p] for p in itertools.combinations(range(n), 2) if not np.isnan(m[p])} for k, m in r.items()} for r in random]
    labels, choices = [], []
    for w in every:
        own = plain_partitions(plain_matrix(channels, w, n), most)
        refs = [[v for v, _ in plain_partitions(plain_matrix(r, w, n), most)] for r in random]
        choices.append(plain_choice([v for v, _ in own], refs, granularity))
        labels.append(own[choices[-1][1] - 1][1])
    assert tuple(found.choice) == choices[0] and found.labels.tolist() == labels[0].tolist()
    stability = round(sum(c[0] == choices[0][0] for c in choices[1:]) / runs, 4)
    assert found.stability == stability
    pairs = n * (n - 1) / 2
    assert found.have == pytest.approx({k: len(v) / pairs for k, v in channels.items()})
    d, k, first = plain_matrix(channels, weights, n), choices[0][1], labels[0]
    cut_often = [round(sum(int(x[i] != x[i + 1]) for x in labels[1:]) / runs, 4) for i in range(n - 1)]
    for j in range(k):
        inside = [i for i in range(n) if first[i] == j]
        terms = [1 - cut_often[i] for i in inside[:-1]] + ([cut_often[inside[0] - 1]] if inside[0] else []) + ([cut_often[inside[-1]]] if inside[-1] < n - 1 else [])
        shape = []
        for i in inside:
            if not 1 < k < n:
                shape.append(min(1, max(0, 1 - sum(d[p] for p in itertools.combinations(range(n), 2)) / pairs)))
                continue
            mean = lambda g: sum(d[i, x] for x in g if x != i) / max(1, sum(x != i for x in g))
            a, b = mean(inside), min(mean([x for x in range(n) if first[x] == o]) for o in range(k) if o != j)
            shape.append(((b - a) / max(a, b) if len(inside) > 1 and max(a, b) > 0 else 0.0) / 2 + 0.5)
        quality = 0.45 * (sum(terms) / len(terms) if terms else 1) + 0.35 * sum(shape) / len(shape) + 0.20 * stability
        assert found.quality[j] == pytest.approx(min(1, max(0, quality)), abs=6e-5)


def test_query_columns_follow_from_cuts(spark):
    """Reviews, coverage and segments of the query's albums from cuts of their photos, whose parts the test above checks."""
    from darkroom.plans.analogs import embedded

    df = embedded(spark, "/root/testdata/sf0.001").where("album_id < 4")
    got = {r.photo_id: r for r in timeline.sequential(df, references=3, runs=3).collect()}
    rows = df.toPandas()
    assert set(got) == set(rows["photo_id"])
    for _, album in rows.groupby("album_id"):
        out = [got[i] for i in album["photo_id"]]
        base, late = timeline._ordered(album)
        cut = timeline.cut(timeline._arrays(base), timeline.STRATEGIES["balanced"], 0, 3, 3, timeline._seed(base, "balanced", 0), timeline.SHAKEN)
        assert {(r.auto_k, r.peak_k, r.chapters, r.k_stability) for r in out} == {(cut.choice.auto, cut.choice.peak, cut.choice.selected, cut.stability)}
        assert [got[i].chapter - 1 for i in base["photo_id"]] == cut.labels.tolist()
        weak = {got[i].chapter for i in late["photo_id"]}
        covered = round(sum(timeline.STRATEGIES["balanced"][c] * round(v, 4) for c, v in cut.have.items()), 4)
        for r in out:
            assert r.coverage == covered and r.quality == round(cut.quality[r.chapter - 1] * (0.85 if r.chapter in weak else 1), 4)
            assert r.needs_review == (covered < 0.50 or cut.stability < 0.60 or r.quality < 0.60 or r.chapter in weak)
        for chapter in {r.chapter for r in out}:
            inside = sorted({r.segment for r in out if r.chapter == chapter})
            assert inside == list(range(1, len(inside) + 1)) and {r.segments for r in out if r.chapter == chapter} == {len(inside)}
            assert all(r.segment_needs_review == (r.segment_quality < 0.60 or r.segment_k_stability < 0.60) for r in out if r.chapter == chapter)
