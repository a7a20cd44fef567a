"""Chapters of a timeline: event boundaries between neighbours, and contiguous clusters of an album's sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import geo, scoring, texts, times, vectors
from darkroom.operators import distances

# fixed values: weights of the channels by strategy
STRATEGIES = {
    "balanced": {"embedding": 0.60, "time": 0.20, "gps": 0.10, "color": 0.10},
    "activity_first": {"embedding": 0.75, "time": 0.10, "gps": 0.05, "color": 0.10},
    "time_first": {"embedding": 0.40, "time": 0.45, "gps": 0.10, "color": 0.05},
    "location_first": {"embedding": 0.40, "time": 0.10, "gps": 0.45, "color": 0.05},
    "segments": {"embedding": 0.75, "time": 0.10, "gps": 0.05, "color": 0.10},
}


class EventRules(NamedTuple):
    """What parts events."""

    threshold: float = 0.45
    hard_gap_hours: float = 30 * 24
    short_gap_hours: float = 2
    short_gap_km: float = 300.0


def event_boundaries(photos: DataFrame, rules: EventRules = EventRules(), hours: list = scoring.BY_HOURS, km: list = scoring.BY_KM) -> DataFrame:
    """Timed photos in order, with score, split, reason and confidence of the step from the photo before, and event (from 1).

    photos: album_id, photo_id, taken_at, lat, lon, tags, histogram (null: unknown). The first photo of an album has no step."""
    order = Window.partitionBy("album_id").orderBy("taken_at", "photo_id")
    before = F.lag(F.struct("taken_at", "lat", "lon", "tags", "histogram")).over(order)
    rows = photos.where(F.col("taken_at").isNotNull()).withColumn("before", before)
    b = F.col("before")
    rows = rows.withColumns({
        "gap_hours": F.abs(times.micros(F.col("taken_at")) - times.micros(b["taken_at"])) / 3.6e9,
        "distance_km": geo.haversine_km(b["lat"], b["lon"], F.col("lat"), F.col("lon")),
        "scene": texts.jaccard(texts.scene_tags(b["tags"]), texts.scene_tags(F.col("tags"))),
        "overlap": vectors.histogram_overlap(b["histogram"], F.col("histogram")),
    })
    gap, far = F.col("gap_hours"), F.col("distance_km")
    parts = [(scoring.piecewise(gap, hours), 0.55), (scoring.piecewise(far, km), 0.25), (F.col("scene"), 0.15), (F.col("overlap"), 0.05)]
    rows = rows.withColumn("score", F.when(gap.isNotNull(), F.round(scoring.clamp(scoring.weighted(parts, 0.0)), 4)))
    # decisions compare what is reported: hours and kilometres of three places, likeness of four
    gap, far = F.round(gap, 3), F.round(far, 3)
    hard, short = gap > rules.hard_gap_hours, (gap <= rules.short_gap_hours) & ~F.coalesce(far > rules.short_gap_km, F.lit(False))
    low = F.col("score") < rules.threshold
    dull = (F.coalesce(F.round("scene", 4), F.lit(1.0)) < 0.35) | (F.coalesce(F.round("overlap", 4), F.lit(1.0)) < 0.35)
    reason = F.when(hard, "large_time_gap").when(short, "short_time_gap").when(~low, "event_continuity").when(far > 50, "location_change").when(dull, "visual_change").when(low, "large_time_gap")
    margin = F.abs(F.col("score") - rules.threshold) / max(rules.threshold, 1 - rules.threshold)
    rows = rows.withColumns({
        "split": F.coalesce(F.when(hard, True).when(short, False).otherwise(low), F.lit(False)),
        "reason": F.when(gap.isNotNull(), reason),
        "confidence": F.when(gap.isNotNull(), F.when(hard | short, 1.0).otherwise(F.round(F.least(F.lit(1.0), margin), 4))),
    })
    return rows.withColumn("event", 1 + F.sum(F.col("split").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("before")


PROFILE = {"gps": 0.45, "scene": 0.35, "overlap": 0.20}


def _profile(**channels: Column) -> Column:
    return scoring.weighted([(channels[c], w) for c, w in PROFILE.items()])


def bounded_profiles(untimed: DataFrame, events: DataFrame, km: list = scoring.BY_KM) -> DataFrame:
    """(album_id, photo_id, event, gps, scene, histogram, low, high, open): each untimed photo and event of its album that can be among the two that it resembles most.

    The best places and scenes are found among distinct values alone. Histograms are continuous, so their likeness is bounded first: it is no more than that to
    the event's envelope (the largest value of each bin over its members) and no less than that to one member. An event whose bound from above is below the second largest bound from
    below is out of the question; open: whether the histograms of the event's members must be looked at, as the bounds differ."""
    tags = texts.scene_tags(F.col("tags"))
    exact = {
        "gps": (F.struct("lat", "lon"), lambda a, b: scoring.piecewise(geo.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]), km)),
        "scene": (F.array_sort(tags), texts.jaccard),
    }
    keyed = untimed.select("album_id", "photo_id", *(value.alias(f"_{c}") for c, (value, _) in exact.items()), F.col("histogram").cast("array<double>").alias("histogram"))
    scored = keyed.join(events.select("album_id", "event").distinct(), "album_id")
    for c, (value, like) in exact.items():
        mine = keyed.select("album_id", F.col(f"_{c}").alias("a")).where(F.col("a").isNotNull()).distinct()
        theirs = events.select("album_id", "event", value.alias("b")).where(F.col("b").isNotNull()).distinct()
        best = mine.join(theirs, "album_id").groupBy("album_id", "event", "a").agg(F.max(like(F.col("a"), F.col("b"))).alias(c)).withColumnRenamed("a", f"_{c}")
        scored = scored.join(best, ["album_id", "event", f"_{c}"], "left")
    members = events.where(F.size("histogram") > 0).select("album_id", "event", "photo_id", F.col("histogram").cast("array<double>").alias("h"), F.size("histogram").alias("bins"))
    place = members.select("album_id", "event", "bins", F.posexplode("h").alias("bin", "v")).groupBy("album_id", "event", "bins", "bin").agg(F.max("v").alias("v"))
    envelope = place.groupBy("album_id", "event", "bins").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda x: x["v"]).alias("envelope"))
    one = members.groupBy("album_id", "event", "bins").agg(F.min_by("h", "photo_id").alias("one"))
    scored = scored.withColumn("bins", F.size("histogram")).join(envelope.join(one, ["album_id", "event", "bins"]), ["album_id", "event", "bins"], "left")
    most, least = vectors.histogram_overlap(F.col("histogram"), F.col("envelope")), vectors.histogram_overlap(F.col("histogram"), F.col("one"))
    # sums of the same numbers in another order may differ in their last digits
    bounds = scored.withColumns({"low": _profile(gps=F.col("gps"), scene=F.col("scene"), overlap=least), "high": _profile(gps=F.col("gps"), scene=F.col("scene"), overlap=most), "open": F.coalesce(most > least, F.lit(False))})
    second = F.nth_value("low", 2).over(Window.partitionBy("album_id", "photo_id").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = bounds.where("low IS NOT NULL").withColumn("second", second).where(F.col("second").isNull() | (F.col("high") >= F.col("second") - 1e-9))
    return kept.select("album_id", "photo_id", "event", "gps", "scene", "histogram", "low", "high", "open")


def assign_untimed(untimed: DataFrame, events: DataFrame, least: float = 0.60, margin: float = 0.15, km: list = scoring.BY_KM) -> DataFrame:
    """(album_id, photo_id, event, profile): the event of the album that a photo without time resembles; null if none is clear.

    Resemblance is the best place (.45), scene (.35) and histogram (.20) similarity to a timed member. It needs `least`, and
    `margin` over the runner-up. Photos are compared with the timed members only, so the result does not depend on an order; histograms meet only
    where bounds leave it open which two events are the best (see bounded_profiles)."""
    near = bounded_profiles(untimed, events, km)
    asked = near.where("open").select("album_id", "event", F.col("histogram").alias("a")).distinct()
    theirs = events.where(F.size("histogram") > 0).select("album_id", "event", F.col("histogram").cast("array<double>").alias("b")).distinct()
    best = asked.join(theirs, ["album_id", "event"]).groupBy("album_id", "event", "a").agg(F.max(vectors.histogram_overlap(F.col("a"), F.col("b"))).alias("overlap")).withColumnRenamed("a", "histogram")
    found = near.join(best.withColumn("open", F.lit(True)), ["album_id", "event", "histogram", "open"], "left")
    found = found.withColumn("profile", F.when(F.col("open"), _profile(gps=F.col("gps"), scene=F.col("scene"), overlap=F.col("overlap"))).otherwise(F.col("low")))
    by = Window.partitionBy("album_id", "photo_id").orderBy(F.desc("profile"), "event")
    top = found.withColumn("nth", F.row_number().over(by)).withColumn("next", F.coalesce(F.lead("profile").over(by), F.lit(0.0))).where("nth = 1")
    sure = (F.col("profile") >= least) & (F.col("profile") - F.col("next") >= margin)
    return untimed.select("album_id", "photo_id").join(top.select("album_id", "photo_id", F.when(sure, F.col("event")).alias("event"), "profile"), ["album_id", "photo_id"], "left")


def pair_distances(photos: DataFrame, weights: dict[str, float], most: int = 2000) -> DataFrame:
    """(album_id, a, b, embedding, time, gps, color, distance) of all pairs within an album, by photo_id.

    For albums of up to `most` photos, which bounds the pairs of one photo; larger ones raise an error and are for
    sequential(). Missing channels are left out and the others' weights rescaled; without any the distance is 1."""
    sized = photos.withColumn("n", F.count("*").over(Window.partitionBy("album_id")))
    checked = sized.where(F.when(F.col("n") > most, F.raise_error(F.lit("album too large for pair_distances"))).otherwise(F.lit(True)).cast("boolean")).drop("n")
    row = checked.select("album_id", "photo_id", "taken_at", "lat", "lon", vectors.normalized(vectors.doubles(F.col("embedding"))).alias("unit"), vectors.shares(F.col("histogram")).alias("shares"))
    a, b = (row.select("album_id", F.struct("*").alias(x)) for x in ("x", "y"))
    x, y = F.col("x"), F.col("y")
    pairs = a.join(b, "album_id").where(x["photo_id"] < y["photo_id"]).select(
        "album_id", x["photo_id"].alias("a"), y["photo_id"].alias("b"), vectors.cosine_distance(x["unit"], y["unit"]).alias("embedding"), vectors.hellinger(x["shares"], y["shares"]).alias("color"),
        (F.abs(times.micros(x["taken_at"]) - times.micros(y["taken_at"])) / 1e6).alias("seconds"), geo.haversine_km(x["lat"], x["lon"], y["lat"], y["lon"]).alias("km"),
    )
    pairs = pairs.join(distances.scales(photos), "album_id").withColumns({"time": scoring.saturating(F.col("seconds"), F.col("time_scale")), "gps": scoring.saturating(F.col("km"), F.col("gps_scale"))})
    return pairs.withColumn("distance", scoring.clamp(scoring.weighted([(F.col(c), w) for c, w in weights.items()], 1.0))).drop("time_scale", "gps_scale")


def coverage(photos: DataFrame) -> DataFrame:
    """Share of an album's pairs that have each channel, from counts: of m photos that have it m (m - 1) / 2 pairs do; embeddings and histograms pair with those of their length."""
    have = {
        "embedding": F.when(vectors.normalized(vectors.doubles(F.col("embedding"))).isNotNull(), F.size("embedding")), "time": F.when(F.col("taken_at").isNotNull(), 1),
        "gps": F.when(geo.valid(F.col("lat"), F.col("lon")), 1), "color": F.when(vectors.shares(F.col("histogram")).isNotNull(), F.size("histogram")),
    }
    of = lambda n: n * (n - 1) / 2
    kinds = photos.select("album_id", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), v.alias("kind")) for c, v in have.items()))).alias("h")).select("album_id", "h.*")
    by = kinds.where("kind IS NOT NULL").groupBy("album_id", "channel", "kind").agg(F.count("*").alias("n")).groupBy("album_id").agg(*(F.sum(F.when(F.col("channel") == c, of(F.col("n")))).alias(c) for c in have))
    total = photos.groupBy("album_id").agg(of(F.count("*")).cast("long").alias("pairs")).where("pairs > 0")
    return total.join(by, "album_id", "left").select("album_id", "pairs", *(F.round(F.coalesce(c, F.lit(0.0)) / F.col("pairs"), 4).alias(c) for c in have))


def dispersion(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """(album_id, dispersion): over clusters, the sum of pair distances divided by the size. sums: of distances.label_sums(); labels(album_id, photo_id, label)."""
    size = labels.groupBy("album_id", "label").agg(F.count("*").alias("n"))
    # each pair is in the sums of both its photos
    inside = sums.where(F.col("label").eqNullSafe(F.col("other"))).groupBy("album_id", "label").agg(F.sum("total").alias("total"))
    per = size.join(inside, ["album_id", "label"]).groupBy("album_id").agg(F.sum(F.col("total") / F.col("n") / 2).alias("dispersion"))
    return labels.select("album_id").distinct().join(per, "album_id", "left").select("album_id", F.greatest(F.coalesce("dispersion", F.lit(0.0)), F.lit(1e-12)).alias("dispersion"))


def silhouette(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """(album_id, photo_id, silhouette) from distances.label_sums(); 0 in clusters of one, and where an album has one cluster."""
    size = labels.groupBy("album_id", F.col("label").alias("other")).agg(F.count("*").alias("n"))
    own = F.col("label") == F.col("other")
    mean = sums.join(size, ["album_id", "other"]).withColumn("d", F.col("total") / F.nullif(F.col("n") - own.cast("int"), F.lit(0)))
    s = mean.groupBy("album_id", "photo_id").agg(F.max(F.when(own, F.col("d"))).alias("i"), F.min(F.when(~own, F.col("d"))).alias("o"))
    s = s.select("album_id", "photo_id", F.coalesce((F.col("o") - F.col("i")) / F.nullif(F.greatest("o", "i"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))
    return labels.select("album_id", "photo_id").join(s, ["album_id", "photo_id"], "left").withColumn("silhouette", F.coalesce("silhouette", F.lit(0.0)))


def chapter_counters(sequence: DataFrame) -> DataFrame:
    """(album_id, chapters, review_chapters, segments, review_segments): how many chapters and segments an album has, and how many of them ask for a review. sequence: of sequential()."""
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    parts = sequence.groupBy("album_id", "chapter", "segment").agg(yes("needs_review").alias("r"), yes("segment_needs_review").alias("s"))
    chapters = parts.groupBy("album_id", "chapter").agg(F.bool_or("r").alias("r"), F.count("segment").alias("n"), F.count_if(F.col("s") & F.col("segment").isNotNull()).alias("s"))
    return chapters.groupBy("album_id").agg(F.count("chapter").alias("chapters"), F.count_if(F.col("r") & F.col("chapter").isNotNull()).alias("review_chapters"), F.sum("n").alias("segments"), F.sum("s").alias("review_segments"))


def chosen_k(gaps: DataFrame) -> DataFrame:
    """(album_id, selected, peak) from (album_id, k, gap, error): the smallest k whose gap is within one standard error of the first largest."""
    order = Window.partitionBy("album_id")
    top = F.max_by(F.struct("k", "gap", "error"), F.struct("gap", -F.col("k"))).over(order)
    rows = gaps.withColumn("top", top).where(F.col("top.gap") - F.col("gap") <= F.sqrt(F.col("top.error") ** 2 + F.col("error") ** 2))
    return rows.groupBy("album_id").agg(F.min("k").alias("selected"), F.first("top.k").alias("peak"))


# ---- an album's sequence as a whole: dynamic programming, which no relational operator expresses ----


def partitioned_all(d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of several distance matrices: costs of the best contiguous partitions into 1 to `most` parts, and where their last parts begin, by number of parts and end.

    A part costs half the mean distance sum of its rows; the earliest start wins among equals. Costs come from one table of running sums of
    distances for each matrix, a row at a time, which is what it needs besides d."""
    many, n = d.shape[:2]
    total = np.zeros((many, n + 1, n + 1))
    np.cumsum(d, axis=1, dtype=float, out=total[:, 1:, 1:])
    np.cumsum(total[:, 1:, 1:], axis=2, out=total[:, 1:, 1:])
    own = np.ascontiguousarray(np.diagonal(total, axis1=1, axis2=2))
    best, start = np.full((many, most + 1, n + 1), np.inf), np.zeros((many, most + 1, n + 1), np.int32)
    best[:, 0, 0] = 0.0
    for end in range(1, n + 1):
        cost = (own[:, end, None] - 2 * total[:, end, :end] + own[:, :end]) / (2.0 * np.arange(end, 0, -1))
        cost[:, -1] = 0.0
        options = best[:, :most, :end] + cost[:, None, :]
        at = options.argmin(2)
        best[:, 1:, end], start[:, 1:, end] = np.take_along_axis(options, at[:, :, None], 2)[:, :, 0], at
    return np.maximum(best[:, 1:, n], 1e-12), start


def partitioned(d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """partitioned_all() of one matrix."""
    costs, start = partitioned_all(d[None], most)
    return costs[0], start[0]


def labels_of(start: np.ndarray, parts: int) -> np.ndarray:
    end = start.shape[1] - 1
    labels = np.zeros(end, int)
    for part in range(parts, 0, -1):
        labels[start[part, end] : end] = part - 1
        end = start[part, end]
    return labels


#: Distances of a stack of matrices, about; a large album's come one by one.
HELD = 1 << 20


def matrices(channels: dict[str, np.ndarray], every: list[dict[str, float]]) -> Iterator[np.ndarray]:
    """Stacks of weighted means of channel matrices, a matrix for each set of weights; NaN where a pair lacks a channel, 1 without any. So many sets at a time as fit into HELD."""
    step = max(1, HELD // max(1, len(next(iter(channels.values()))) ** 2))
    for at in range(0, len(every), step):
        yield _stack(channels, every[at : at + step])


def _stack(channels: dict[str, np.ndarray], part: list[dict[str, float]]) -> np.ndarray:
    some = next(iter(channels.values()))
    total, weight = (np.zeros((len(part), *some.shape), some.dtype) for _ in range(2))
    for name in part[0]:
        have = ~np.isnan(channels[name])
        w = np.array([x[name] for x in part], some.dtype)[:, None, None]
        np.add(total, channels[name] * w, out=total, where=have)
        np.add(weight, w, out=weight, where=have)
    np.divide(total, weight, out=total, where=weight > 0)
    total[weight == 0] = 1
    np.clip(total, 0, 1, out=total)
    total[:, np.arange(len(some)), np.arange(len(some))] = 0.0
    return total


def matrix(channels: dict[str, np.ndarray], weights: dict[str, float]) -> np.ndarray:
    """matrices() of one set of weights."""
    return next(matrices(channels, [weights]))[0]


def _scale(x: np.ndarray) -> float:
    x = x[np.triu_indices(len(x), 1)]
    x = x[x > 0]
    if not len(x):
        return 1.0
    q = np.percentile(x, [25, 50, 75])
    return max(q[2] - q[0], q[1], 1e-9)


#: Albums of more photos have distances of single precision, and are dealt over tasks by reference.
LARGE = 400


def _arcs(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Kilometres between places, in the type of the inputs."""
    a = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(a)))


def _hellinger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of square roots: from their products, without differences of all pairs."""
    return np.sqrt(np.maximum(0, ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)) / 2))


def channels(t: np.ndarray, e: np.ndarray, lat: np.ndarray, lon: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """Distances of all pairs of an album in each channel; rows of NaN lack it."""
    n, kind = len(t), np.float32 if len(t) > LARGE else np.float64
    with np.errstate(invalid="ignore"):
        seconds = np.abs(t[:, None] - t[None, :])
        seconds = (seconds / (seconds + _scale(seconds))).astype(kind)
        y, x = np.radians(lat).astype(kind), np.radians(lon).astype(kind)
        km = _arcs(y[:, None], x[:, None], y[None, :], x[None, :])
        km = (km / (km + kind(_scale(km)))).astype(kind)
        root, e = np.sqrt(c).astype(kind), e.astype(kind)
        hell = _hellinger(root, root) if c.size else np.full((n, n), np.nan, kind)
        cos = np.clip((1 - e @ e.T) / 2, 0, 1) if e.size else np.full((n, n), np.nan, kind)
        for m in (hell, cos):
            np.fill_diagonal(m, np.where(np.isnan(np.diagonal(m)), np.nan, 0))
        return {"embedding": cos, "time": seconds, "gps": km, "color": hell}


def _box(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A uniform sample of the box that x fills along its principal axes."""
    have = ~np.isnan(x).any(1) if x.size else np.zeros(len(x), bool)
    out = x.copy()
    if have.sum() > 1:
        rows = x[have]
        centre = rows - rows.mean(0)
        axes = np.linalg.svd(centre, full_matrices=False)[2]
        scores = centre @ axes.T
        out[have] = rng.uniform(scores.min(0), scores.max(0), scores.shape) @ axes + rows.mean(0)
    return out


def reference(t: np.ndarray, e: np.ndarray, lat: np.ndarray, lon: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Channels of a sequence of the same extent without structure."""
    e2 = _box(e, rng)
    if e.size:
        e2 = e2 / np.maximum(np.linalg.norm(e2, axis=1, keepdims=True), 1e-12)
    c2 = np.clip(_box(c, rng), 0, None)
    if c.size:
        c2 = c2 / np.maximum(c2.sum(1, keepdims=True), 1e-12)
    t2, known = t.copy(), ~np.isnan(t)
    if known.any():
        t2[known] = np.sort(rng.uniform(t[known].min(), t[known].max(), known.sum()))
    at, lat2, lon2 = ~np.isnan(lat), lat.copy(), lon.copy()
    if at.any():
        lat2[at], lon2[at] = rng.uniform(lat[at].min(), lat[at].max(), at.sum()), rng.uniform(lon[at].min(), lon[at].max(), at.sum())
    return channels(t2, e2, lat2, lon2, c2)


class Choice(NamedTuple):
    auto: int
    selected: int
    peak: int


def choose(own: np.ndarray, refs: np.ndarray, granularity: int = 0) -> Choice:
    """Number of parts by the gap statistic, from costs by number of parts, of references in rows: the smallest within one standard error of the peak, moved by granularity."""
    most = len(own)
    if most <= 1:
        return Choice(1, 1, 1)
    logs = np.log(refs)
    gaps = logs.mean(0) - np.log(own)
    errors = logs.std(0, ddof=1) * np.sqrt(1 + 1 / len(refs))
    peak = int(gaps.argmax())
    auto = 1 + int(np.flatnonzero(gaps[peak] - gaps <= np.sqrt(errors[peak] ** 2 + errors**2))[0])
    return Choice(auto, int(np.clip(auto + granularity, 1, most)), peak + 1)


def most_parts(n: int) -> int:
    return 1 if n <= 2 else min(n - 1, int(np.ceil(np.sqrt(n))) + 1)


def shaken_weights(weights: dict[str, float], runs: int, seed: int) -> list[dict[str, float]]:
    """The weights, and perturbed ones for each run."""
    rng, out = np.random.default_rng(seed), [weights]
    for _ in range(max(1, runs)):
        factor = rng.lognormal(0.0, 0.10, len(weights))
        w = {k: v * f for (k, v), f in zip(weights.items(), factor, strict=True)}
        out.append({k: v / sum(w.values()) for k, v in w.items()})
    return out


def reference_costs(data: tuple[np.ndarray, ...], every: list[dict[str, float]], seed: int, nth: int) -> np.ndarray:
    """Costs of the nth reference's partitions by weights and number of parts. One reference's distances live at a time."""
    made = reference(*data, np.random.default_rng([seed, nth]))
    return np.concatenate([partitioned_all(m, most_parts(len(data[0])))[0] for m in matrices(made, every)])


SEGMENT_COLUMNS = {"segment": int, "segments": int, "segment_auto_k": int, "segment_peak_k": int, "segment_k_stability": float, "segment_quality": float, "segment_needs_review": bool}
SQL_TYPES = {int: "int", float: "double", bool: "boolean"}


class Cut(NamedTuple):
    choice: Choice
    labels: np.ndarray
    stability: float
    quality: list[float]
    have: dict[str, float]


def cut(data: tuple[np.ndarray, ...], weights: dict[str, float], granularity: int, references: int, runs: int, seed: int, shaken: int, known: np.ndarray | None = None) -> Cut:
    """Contiguous parts of a sequence, how often perturbed weights choose as many, the quality of each part, and the share of pairs with each channel.

    known: costs of references (reference, weights, parts), where they were found elsewhere."""
    n, every = len(data[0]), shaken_weights(weights, runs, seed ^ shaken)
    if known is None:
        known = np.stack([reference_costs(data, every, seed, r) for r in range(max(2, references))])
    own, cuts, same, d = channels(*data), np.zeros(max(0, n - 1)), 0, None
    j = 0
    for stack in matrices(own, every):
        for m, costs, start in zip(stack, *partitioned_all(stack, most_parts(n)), strict=True):
            choice = choose(costs, known[:, j], granularity)
            labels = labels_of(start, choice.selected)
            if j == 0:
                first, chosen, d = choice, labels, m.copy()
            else:
                cuts += labels[1:] != labels[:-1]
                same += choice.auto == first.auto
            j += 1
    cuts, stability = np.round(cuts / max(1, runs), 4), round(same / max(1, runs), 4) if n > 1 else 1.0
    labels = chosen
    pairs = np.triu_indices(n, 1)
    have = {k: float((~np.isnan(m[pairs])).mean()) if n > 1 else 1.0 for k, m in own.items()}
    k = labels.max() + 1 if n else 0
    if 1 < k < n:
        mean = np.stack([d[:, labels == j].sum(1) for j in range(k)], 1)
        size = np.bincount(labels)
        a = mean[np.arange(n), labels] / np.maximum(size[labels] - 1, 1)
        other = mean / size
        other[np.arange(n), labels] = np.inf
        b = other.min(1)
        sil = np.where(size[labels] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        sil = (sil + 1) / 2
    else:
        sil = np.full(n, np.clip(1 - (d[pairs].mean() if n > 1 else 0.0), 0, 1))
    quality = []
    for j in range(k):
        at = np.flatnonzero(labels == j)
        terms = [1 - cuts[i] for i in range(at[0], at[-1])] + ([cuts[at[0] - 1]] if at[0] > 0 else []) + ([cuts[at[-1]]] if at[-1] < n - 1 else [])
        quality.append(round(float(np.clip(0.45 * (np.mean(terms) if terms else 1.0) + 0.35 * sil[at].mean() + 0.20 * stability, 0, 1)), 4))
    return Cut(first, labels, stability, quality, have)


def _stacked(column: pd.Series, scale) -> np.ndarray:
    have = [np.asarray(v, float) if v is not None and len(v) else None for v in column]
    sizes = [len(v) for v in have if v is not None]
    if not sizes:
        return np.zeros((len(column), 0))
    width = max(dict.fromkeys(sizes), key=sizes.count)
    out = np.full((len(column), width), np.nan)
    for i, v in enumerate(have):
        if v is not None and len(v) == width and np.isfinite(v).all() and scale(v) > 0:
            out[i] = v / scale(v)
    return out


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Times, embeddings, places and histograms of photos; NaN where they lack one."""
    t = (pd.to_datetime(rows["taken_at"]).astype("datetime64[us]").astype("int64") / 1e6).where(rows["taken_at"].notna()).to_numpy(float)
    lat, lon = rows["lat"].to_numpy(float), rows["lon"].to_numpy(float)
    bad = ~((np.abs(lat) <= 90) & (np.abs(lon) <= 180))
    return t, _stacked(rows["embedding"], np.linalg.norm), np.where(bad, np.nan, lat), np.where(bad, np.nan, lon), _stacked(rows["histogram"], np.sum)


def _ordered(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The sequence, and the photos without a time, which are the sequence where all lack one."""
    timed = rows[rows["taken_at"].notna()].sort_values(["taken_at", "photo_id"])
    late = rows[rows["taken_at"].isna()].sort_values("photo_id")
    return (timed, late) if len(timed) else (late, late.iloc[:0])


def _seed(base: pd.DataFrame, strategy: str, granularity: int) -> int:
    return int.from_bytes(hashlib.sha256(("|".join(map(str, base["photo_id"])) + f"{strategy}:{granularity}").encode()).digest()[:8], "big")


def _beside(i: int, others: np.ndarray, place: tuple[np.ndarray, ...], weights: dict[str, float]) -> np.ndarray:
    """Distances of a photo without a time to others. Of two places alone the scale is their own distance, so apart counts one half."""
    _, e, lat, lon, c = place
    with np.errstate(invalid="ignore"):
        y, x = np.radians(lat), np.radians(lon)
        km = _arcs(y[i], x[i], y[others], x[others])
        made = {
            "embedding": np.clip((1 - e[others] @ e[i]) / 2, 0, 1) if e.size else np.full(len(others), np.nan), "time": np.full(len(others), np.nan),
            "gps": np.where(np.isnan(km), np.nan, np.where(km > 0, 0.5, 0.0)), "color": _hellinger(np.sqrt(c[others]), np.sqrt(c[i : i + 1]))[:, 0] if c.size else np.full(len(others), np.nan),
        }
    total, weight = np.zeros(len(others)), np.zeros(len(others))
    for name, w in weights.items():
        have = ~np.isnan(made[name])
        total[have] += w * made[name][have]
        weight[have] += w
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 1.0)


SHAKEN = 0xC7C7


def sequential(photos: DataFrame, strategy: str = "balanced", granularity: int = 0, references: int = 20, runs: int = 20, large: int = LARGE) -> DataFrame:
    """(album_id, photo_id, chapter, chapters, auto_k, peak_k, k_stability, quality, coverage, needs_review) of every photo, and SEGMENT_COLUMNS.

    An album's timed photos in order are cut into contiguous chapters; the number of chapters is chosen by the gap statistic
    against references without structure, and its stability is tested by perturbing the weights. Photos without a time join the chapter
    whose members are nearest on average. Each chapter, these included, is cut into segments in the same way, by at most 5 references
    and runs. Random numbers are seeded by the album's ids, so the result does not depend on partitioning.

    Albums run in parallel; of those of more than `large` photos each reference is a task of its own. A task holds the distances of one
    album and of one reference at most: about 32 bytes a pair, so 5000 photos take 0.8 GB; albums that exceed a task's memory have no other way."""
    weights = STRATEGIES.get(strategy, STRATEGIES["balanced"])
    granularity = max(-2, min(2, granularity))
    kinds = dict(photos.dtypes)

    def trial(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base, _ = _ordered(rows)
        seed = _seed(base, strategy, granularity)
        costs = reference_costs(_arrays(base), shaken_weights(weights, runs, seed ^ SHAKEN), seed, key[1])
        return pd.DataFrame({"album": [key[0]], "nth": [key[1]], "costs": [costs.ravel()]})

    def cluster(_key: tuple, rows: pd.DataFrame, trials: pd.DataFrame) -> pd.DataFrame:
        base, late = _ordered(rows)
        seed, known = _seed(base, strategy, granularity), None
        if len(trials):
            known = np.stack(trials.sort_values("nth")["costs"].tolist()).reshape(len(trials), max(1, runs) + 1, -1)
        first, labels, stability, quality, have = cut(_arrays(base), weights, granularity, references, runs, seed, SHAKEN, known)
        n, k = len(base), len(quality)
        covered = round(sum(weights[c] * round(v, 4) for c, v in have.items()), 4)
        every = pd.concat([base, late])
        chapter, weak = np.concatenate([labels, np.full(len(late), -1)]).astype(int), set()
        place = _arrays(every)
        for i in range(n, len(every)):
            far, inside = _beside(i, np.arange(i), place, weights), chapter[:i]
            at = int(np.argmin(np.bincount(inside, far, k) / np.bincount(inside, minlength=k)))
            chapter[i] = at
            weak.add(at)
        groups = [np.flatnonzero(chapter == j) for j in range(k)]
        q = [round(quality[j] * (0.85 if j in weak else 1), 4) for j in range(k)]
        poor = covered < 0.50 or stability < 0.60
        inner = {c: np.empty(len(every), t) for c, t in SEGMENT_COLUMNS.items()}
        for j, g in enumerate(groups):
            own = seed ^ int.from_bytes(hashlib.sha256(str(j).encode()).digest()[:8], "big")
            part, parts, steady, good, _ = cut(tuple(x[g] for x in place), STRATEGIES["segments"], 0, min(references, 5), min(runs, 5), own, 0x5E6D3)
            good = np.array(good)[parts]
            for c, v in zip(SEGMENT_COLUMNS, (parts + 1, part.selected, part.auto, part.peak, steady, good, (good < 0.60) | (steady < 0.60)), strict=True):
                inner[c][g] = v
        return pd.DataFrame({
            "album_id": every["album_id"], "photo_id": every["photo_id"], "chapter": chapter + 1, "chapters": k, "auto_k": first.auto, "peak_k": first.peak, "k_stability": stability,
            "quality": [q[j] for j in chapter], "coverage": covered, "needs_review": [bool(poor or q[j] < 0.60 or j in weak) for j in chapter], **inner,
        })

    rows = photos.select("album_id", "photo_id", "taken_at", "lat", "lon", "embedding", "histogram")
    big = rows.groupBy("album_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("album_id")
    dealt = rows.join(big, "album_id", "left_semi").withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(max(2, references) - 1))))
    trials = dealt.groupBy("album_id", "nth").applyInPandas(trial, f"album {kinds['album_id']}, nth int, costs array<double>")
    schema = f"album_id {kinds['album_id']}, photo_id {kinds['photo_id']}, chapter int, chapters int, auto_k int, peak_k int, k_stability double, quality double, coverage double, needs_review boolean, "
    return rows.groupBy("album_id").cogroup(trials.groupBy("album")).applyInPandas(cluster, schema + ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in SEGMENT_COLUMNS.items()))
