"""Sums and order statistics over all pairs of an album's photos, without a row for each pair.

Photos of an album are dealt into blocks of about SIZE by a hash. A tile is two blocks of one album (or one block with itself); a task holds one
tile's arrays, finds its pairs by matrix products and puts out sums by photo. Every block goes to as many tiles as its album has blocks, so what is
exchanged grows with photos times blocks, not with pairs, and an album of any size is spread. Albums of one block skip the exchange of blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import geo, texts, times, vectors
from darkroom.sources.lineage import written

SIZE = 512
QUARTILES = (0.25, 0.5, 0.75)


def tiled(rows: DataFrame, by: list[str], key: Column, pack: Callable[[pd.DataFrame], dict], compute: Callable[[dict, dict | None], pd.DataFrame], schema: str, size: int = SIZE) -> DataFrame:
    """by, and what compute(x, y) gives for each tile (y is None: x with itself). pack: of a block's rows, without nulls in `by`; key: what deals rows into blocks."""
    kinds = dict(rows.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in by), schema])
    count = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    placed = rows.join(count, by).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))

    def named(found: pd.DataFrame, own: tuple) -> pd.DataFrame:
        for n, value in enumerate(own):
            found.insert(n, by[n], pd.Series([value] * len(found), index=found.index, dtype=object))
        return found

    def alone(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return named(compute(pack(part), None), own)

    def packed(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*own, int(part["_blocks"].iloc[0]), pickle.dumps(pack(part), protocol=5))], columns=[*by, "_block", "_blocks", "_blob"])

    def tile(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        blobs = [pickle.loads(b) for b in part.sort_values("_block")["_blob"]]
        return named(compute(blobs[0], blobs[1] if len(blobs) > 1 else None), own[:-2])

    one = placed.where("_blocks = 1").groupBy(*by).applyInPandas(alone, out)
    blocks = placed.where("_blocks > 1").groupBy(*by, "_block").applyInPandas(packed, ", ".join([*(f"{c} {kinds[c]}" for c in by), "_block long, _blocks long, _blob binary"]))
    each = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    met = each.select(*by, F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"), "_block", "_blob")
    return one.unionByName(met.groupBy(*by, "_x", "_y").applyInPandas(tile, out))


# ---- order statistics of differences ----


def pair_order(values: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The differences of these ranks (from 0) among the positive differences of all pairs; values: ascending distinct integers, counts: how often each occurs.

    Pairs that differ by at most x are counted by one search of each value plus x; the least x with enough of them is found by bisection. n log n each."""
    before = np.concatenate([[0], np.cumsum(counts)])

    def within(x: int) -> int:
        return int((counts * (before[np.searchsorted(values, values + x, "right")] - before[1:])).sum())

    out = []
    for rank in ranks:
        low, high = 0, int(values[-1] - values[0])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if within(middle) > rank else (middle + 1, high)
        out.append(low)
    return np.array(out, np.int64)


def interpolated(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n ascending values, the ranks on both sides of each quartile (lower ones first) and its place between them."""
    at = np.array(QUARTILES) * (n - 1)
    low = np.floor(at).astype(np.int64)
    return np.concatenate([low, np.minimum(low + 1, n - 1)]), at - low


def scale_of(sides: np.ndarray, place: np.ndarray) -> float:
    """The larger of interquartile range and median, from the values at the ranks of interpolated()."""
    q = sides[:3] + (sides[3:] - sides[:3]) * place
    return float(max(q[2] - q[0], q[1], 1e-9))


#: Distinct times that one task holds, about, and points at which a pass over them counts pairs for each wanted rank.
TIMES, POINTS = 500_000, 32


def time_scales(photos: DataFrame, size: int = TIMES) -> DataFrame:
    """(album_id, time_scale): the robust scale in seconds of all pairs of an album's times; 1 where no two differ.

    A task holds an album's distinct times, 16 bytes each, or a block of them where an album has more than `size` (_spread_orders())."""
    kind = dict(photos.dtypes)["album_id"]

    def scale(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        values, counts = part["at"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        pairs = (int(counts.sum()) ** 2 - int((counts**2).sum())) // 2
        found = 1.0
        if pairs:
            ranks, place = interpolated(pairs)
            found = scale_of(pair_order(values, counts, ranks) / 1e6, place)
        return pd.DataFrame({"album_id": [own[0]], "time_scale": [found]})

    at = photos.where("taken_at IS NOT NULL").groupBy("album_id", times.micros(F.col("taken_at")).alias("at")).agg(F.count("*").alias("n"))
    at = written(at, "times")
    count = at.groupBy("album_id").agg(F.count("*").alias("times"))
    whole = lambda rows: rows.groupBy("album_id").applyInPandas(scale, f"album_id {kind}, time_scale double")
    many = count.where((F.col("times") > size) & F.col("album_id").isNotNull())
    total = many.agg(F.sum("times")).first()[0]
    if not total:
        return whole(at)
    few = whole(at.join(many, "album_id", "left_anti"))
    ranges = at.join(many.select("album_id"), "album_id").repartitionByRange(total // size + 2, "album_id", "at").withColumn("block", F.spark_partition_id())
    return few.unionByName(at.sparkSession.createDataFrame(_spread_orders(written(ranges, "ranges"), kind), few.schema))


def _spread_orders(ranges: DataFrame, kind: str) -> list[tuple]:
    """[(album_id, time_scale)] of ranges(album_id, at, n, block), whose blocks follow each other in time.

    Each pass counts the pairs that differ by at most so much, for POINTS of every range that may hold a wanted rank, and keeps the part between two points. Pairs of blocks that
    lie wholly within or beyond a point are counted by their sizes, so for one point a block meets no more others than about two: passes are linear in the times.
    The driver holds what a block's size and ends are."""

    def pack(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        at, n = part["at"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        return pd.DataFrame([(*own, at[0], at[-1], n.sum(), (n**2).sum(), at.tobytes(), n.tobytes())], columns=["album_id", "block", "low", "high", "n", "squares", "at", "counts"])

    def count(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        read = [(np.frombuffer(r.at, np.int64), np.frombuffer(r.counts, np.int64), r.points) for r in part.sort_values("low").itertuples()]
        (x, w, points), (y, v, _) = read[0], read[-1]
        before = np.concatenate([[0], np.cumsum(v)])
        own_part = before[1:] if len(read) == 1 else 0
        return pd.DataFrame([(own[0], int(d), int((w * (before[np.searchsorted(y, x + d, "right")] - own_part)).sum())) for d in points], columns=["album_id", "point", "pairs"])

    blocks = ranges.groupBy("album_id", "block").applyInPandas(pack, f"album_id {kind}, block int, low long, high long, n long, squares long, at binary, counts binary")
    blocks = written(blocks, "blocks")
    spark = blocks.sparkSession
    albums: dict = {}
    for r in blocks.select("album_id", "low", "high", "n", "squares", "block").collect():
        albums.setdefault(r.album_id, []).append((r.low, r.high, r.n, r.squares, r.block))
    wanted = {}
    for own, parts in albums.items():
        parts.sort()
        pairs = (sum(p[2] for p in parts) ** 2 - sum(p[3] for p in parts)) // 2
        ranks, place = interpolated(pairs)
        wanted[own] = [ranks, place, [[0, parts[-1][1] - parts[0][0]] for _ in ranks]]
    while True:
        known, tiles = {}, {}
        for own, (_, _, found) in wanted.items():
            for d in {low + (high - low) * k // (POINTS + 1) for low, high in found if low < high for k in range(1, POINTS + 1)}:
                sure = 0
                for i, (low, high, n, squares, x) in enumerate(albums[own]):
                    if high - low <= d:
                        sure += (n * n - squares) // 2
                    else:
                        tiles.setdefault((own, x, x), []).append(d)
                    for next_low, next_high, m, _, y in albums[own][i + 1 :]:
                        if next_low - high > d:
                            break
                        if next_high - low <= d:
                            sure += n * m
                        else:
                            tiles.setdefault((own, x, y), []).append(d)
                known[own, d] = sure
        if not known:
            break
        if tiles:
            met = spark.createDataFrame([(own, x, y, ds, b) for (own, x, y), ds in tiles.items() for b in {x, y}], f"album_id {kind}, x int, y int, points array<long>, block int")
            counted = blocks.join(F.broadcast(met), ["album_id", "block"]).groupBy("album_id", "x", "y").applyInPandas(count, f"album_id {kind}, point long, pairs long")
            for r in counted.groupBy("album_id", "point").agg(F.sum("pairs").alias("pairs")).collect():
                known[r.album_id, r.point] += r.pairs
        for own, (ranks, _, found) in wanted.items():
            points = sorted(d for o, d in known if o == own)
            for rank, ends in zip(ranks, found, strict=True):
                for d in points:
                    if ends[0] <= d < ends[1]:
                        if known[own, d] > rank:
                            ends[1] = d
                        else:
                            ends[0] = d + 1
    return [(own, scale_of(np.array([low for low, _ in found], np.int64) / 1e6, place)) for own, (_, place, found) in wanted.items()]


def kilometres(x: dict, y: dict) -> np.ndarray:
    """Distances between the places of two blocks; NaN where one has none."""
    a = np.sin((y["lat"][None, :] - x["lat"][:, None]) / 2) ** 2 + np.cos(x["lat"])[:, None] * np.cos(y["lat"])[None, :] * np.sin((y["lon"][None, :] - x["lon"][:, None]) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(a)))


#: Bits of a distance that each pass tells apart, from the top: sign, exponent and 9 bits first.
STEPS = (42, 21, 0)


def place_scales(photos: DataFrame, size: int = SIZE) -> DataFrame:
    """(album_id, gps_scale): the robust scale in kilometres of all pairs of an album's places; 1 where no two differ.

    Places count once with their number. Albums of several blocks are read in three passes over their tiles: each counts distances by the next bits of
    those that begin like a wanted one, so the passes narrow down to the very values at the wanted ranks (a radix selection)."""
    kind = dict(photos.dtypes)["album_id"]
    places = photos.where(geo.valid(F.col("lat"), F.col("lon"))).groupBy("album_id", "lat", "lon").agg(F.count("*").alias("w"))
    places = written(places, "places")
    count = places.groupBy("album_id").agg(F.count("*").alias("places"))

    def values(x: dict, y: dict | None) -> tuple[np.ndarray, np.ndarray]:
        d, w = kilometres(x, x if y is None else y), x["w"][:, None] * (x if y is None else y)["w"][None, :]
        some = (d > 0) & (np.triu(np.ones(d.shape, bool), 1) if y is None else True)
        return d[some], w[some]

    def pack(part: pd.DataFrame) -> dict:
        out = {"lat": np.radians(part["lat"].to_numpy(float)), "lon": np.radians(part["lon"].to_numpy(float)), "w": part["w"].to_numpy(np.int64)}
        return out | {"targets": np.array(part["targets"].iloc[0], np.int64)} if "targets" in part else out

    def whole(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        d, w = values(pack(part), None)
        found = 1.0
        if len(d):
            order = np.argsort(d)
            ranks, place = interpolated(int(w.sum()))
            found = scale_of(d[order][np.searchsorted(np.cumsum(w[order]), ranks, "right")], place)
        return pd.DataFrame({"album_id": [own[0]], "gps_scale": [found]})

    small = places.join(count.where(F.col("places") <= size), "album_id").groupBy("album_id").applyInPandas(whole, f"album_id {kind}, gps_scale double")
    large = places.join(count.where(F.col("places") > size).select("album_id"), "album_id")
    if large.isEmpty():
        return small

    def counted(step: int, x: dict, y: dict | None) -> pd.DataFrame:
        d, w = values(x, y)
        bits = d.view(np.int64)
        parent = bits >> (STEPS[step - 1] if step else 63)
        if step:
            some = np.isin(parent, x["targets"])
            bits, parent, w = bits[some], parent[some], w[some]
        keys, at = np.unique(bits >> STEPS[step], return_inverse=True)
        return pd.DataFrame({"parent": keys >> (STEPS[step - 1] - STEPS[step]) if step else np.zeros(len(keys), np.int64), "bits": keys, "n": np.bincount(at, weights=w, minlength=len(keys)).astype(np.int64)})

    target = f"album_id {kind}, which int, bits long, rest long, place double"
    targets = None
    for step in range(len(STEPS)):
        rows = large if targets is None else large.join(targets.groupBy("album_id").agg(F.array_distinct(F.collect_list("bits")).alias("targets")), "album_id")
        found = tiled(rows, ["album_id"], F.struct("lat", "lon"), pack, lambda x, y, step=step: counted(step, x, y), "parent long, bits long, n long", size)
        summed = found.groupBy("album_id", "parent", "bits").agg(F.sum("n").alias("n"))

        def narrowed(own: tuple, part: pd.DataFrame, wanted: pd.DataFrame | None = None) -> pd.DataFrame:
            part = part.sort_values(["parent", "bits"])
            if wanted is None:
                ranks, place = interpolated(int(part["n"].sum()))
                wanted = pd.DataFrame({"which": range(6), "bits": 0, "rest": ranks, "place": np.tile(place, 2)})
            out = []
            for which, bits, rest, place in zip(wanted["which"], wanted["bits"], wanted["rest"], wanted["place"], strict=True):
                mine = part[part["parent"] == bits]
                upto = mine["n"].cumsum().to_numpy()
                i = int(np.searchsorted(upto, rest, "right"))
                out.append((own[0], which, int(mine["bits"].iloc[i]), int(rest - (upto[i - 1] if i else 0)), place))
            return pd.DataFrame(out, columns=["album_id", "which", "bits", "rest", "place"])

        if targets is None:
            targets = written(summed.groupBy("album_id").applyInPandas(lambda own, part: narrowed(own, part), target), "targets")
        else:
            # another name on the right, as both sides may come from the same albums
            wanted = targets.withColumnRenamed("album_id", "album")
            targets = written(summed.groupBy("album_id").cogroup(wanted.groupBy("album")).applyInPandas(lambda own, part, wanted: narrowed(own, part, wanted), target), "targets")

    def finished(own: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("which")
        return pd.DataFrame({"album_id": [own[0]], "gps_scale": [scale_of(part["bits"].to_numpy(np.int64).view(float), part["place"].to_numpy()[:3])]})

    # an album whose places do not differ at all has no target
    exact = targets.groupBy("album_id").applyInPandas(finished, f"album_id {kind}, gps_scale double")
    return small.unionByName(exact)


def scales(photos: DataFrame, size: int = SIZE) -> DataFrame:
    """(album_id, time_scale, gps_scale) of every album: the larger of interquartile range and median of the positive differences of its pairs; 1 without any."""
    albums = photos.select("album_id").distinct().join(time_scales(photos), "album_id", "left").join(place_scales(photos, size), "album_id", "left")
    return albums.select("album_id", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("time_scale", "gps_scale")))


# ---- sums of distances ----


def _rows_of(values: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: (places, matrix)."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.stack([np.asarray(values.iloc[i], float) for i in at])) for n, at in by.items()}


def _products(x: dict, y: dict, name: str, shape: tuple[int, int]) -> np.ndarray:
    """Inner products of vectors of equal length; NaN for others."""
    out = np.full(shape, np.nan)
    for n, (at, rows) in x[name].items():
        if n in y[name]:
            to, others = y[name][n]
            out[np.ix_(at, to)] = rows @ others.T
    return out


def distance(x: dict, y: dict, weights: dict[str, float]) -> np.ndarray:
    """Distances between the photos of two blocks: the weighted mean of the channels that both have, 1 without any."""
    shape = (len(x["t"]), len(y["t"]))
    seconds, km = np.abs(x["t"][:, None] - y["t"][None, :]), kilometres(x, y)
    time_scale, gps_scale = x["scales"]
    found = {
        "embedding": np.clip((1 - _products(x, y, "unit", shape)) / 2, 0, 1), "color": np.sqrt(np.maximum(0, 1 - _products(x, y, "roots", shape))),
        "time": seconds / (seconds + time_scale), "gps": km / (km + gps_scale),
    }
    total, weight = np.zeros(shape), np.zeros(shape)
    for name, w in weights.items():
        have = ~np.isnan(found[name])
        total[have] += w * found[name][have]
        weight += w * have
    return np.clip(np.divide(total, weight, out=np.ones(shape), where=weight > 0), 0, 1)


def label_sums(photos: DataFrame, labels: DataFrame, weights: dict[str, float], size: int = SIZE) -> DataFrame:
    """(album_id, photo_id, label, other, total): for each photo and each label of its album, the sum of its distances to the photos with that label, itself left out. labels(album_id, photo_id, label)."""
    kinds = dict(labels.dtypes) | {c: dict(photos.dtypes)[c] for c in ("album_id", "photo_id")}
    here = geo.valid(F.col("lat"), F.col("lon"))
    rows = photos.select(
        "album_id", "photo_id", (times.micros(F.col("taken_at")) / 1e6).alias("t"), F.when(here, F.radians("lat")).alias("lat"), F.when(here, F.radians("lon")).alias("lon"),
        vectors.normalized(vectors.doubles(F.col("embedding"))).alias("unit"), F.transform(vectors.shares(F.col("histogram")), F.sqrt).alias("roots"),
    ).join(labels.select("album_id", "photo_id", "label"), ["album_id", "photo_id"]).join(scales(photos, size), "album_id")

    def pack(part: pd.DataFrame) -> dict:
        codes, names = pd.factorize(part["label"], use_na_sentinel=False)
        return {
            "id": part["photo_id"].to_numpy(), "label": codes, "labels": list(names), "t": part["t"].to_numpy(float), "lat": part["lat"].to_numpy(float), "lon": part["lon"].to_numpy(float),
            "unit": _rows_of(part["unit"]), "roots": _rows_of(part["roots"]), "scales": (float(part["time_scale"].iloc[0]), float(part["gps_scale"].iloc[0])),
        }

    def sums(x: dict, y: dict, d: np.ndarray) -> pd.DataFrame:
        k = len(y["labels"])
        total = d @ np.eye(k)[y["label"]]
        return pd.DataFrame({"photo_id": np.repeat(x["id"], k), "label": np.repeat(np.array(x["labels"], object)[x["label"]], k), "other": np.tile(np.array(y["labels"], object), len(x["id"])), "total": total.ravel()})

    def compute(x: dict, y: dict | None) -> pd.DataFrame:
        d = distance(x, x if y is None else y, weights)
        if y is None:
            np.fill_diagonal(d, 0.0)
            return sums(x, x, d)
        return pd.concat([sums(x, y, d), sums(y, x, d.T)], ignore_index=True)

    found = tiled(rows, ["album_id"], F.col("photo_id"), pack, compute, f"photo_id {kinds['photo_id']}, label {kinds['label']}, other {kinds['label']}, total double", size)
    return found.groupBy("album_id", "photo_id", "label", "other").agg(F.sum("total").alias("total"))


def similarity(x: dict, y: dict) -> np.ndarray:
    """Visual similarity of two blocks: from embeddings of equal length, else scenes (.75) and histograms (.25), NaN without both."""
    shape = (len(x["id"]), len(y["id"]))
    found = np.clip((_products(x, y, "embedding", shape) - 0.2) / 0.75, 0, 1)
    lack = np.isnan(found)
    rows, columns = np.flatnonzero(lack.any(1)), np.flatnonzero(lack.any(0))
    if len(rows) and len(columns):
        names = {t: n for n, t in enumerate(dict.fromkeys(t for b, at in ((x, rows), (y, columns)) for i in at for t in b["tags"][i]))}
        has = []
        for b, at in ((x, rows), (y, columns)):
            m = np.zeros((len(at), len(names)))
            for i, j in enumerate(at):
                m[i, [names[t] for t in b["tags"][j]]] = 1
            has.append(m)
        common, sizes = has[0] @ has[1].T, (has[0].sum(1), has[1].sum(1))
        either = sizes[0][:, None] + sizes[1][None, :] - common
        scene = np.divide(common, either, out=np.full(common.shape, np.nan), where=(sizes[0][:, None] > 0) & (sizes[1][None, :] > 0))
        overlap = np.full(shape, np.nan)
        for n, (at, values) in x["histogram"].items():
            to, others = y["histogram"].get(n, (np.zeros(0, int), None))
            for i, v in zip(at, values, strict=True):
                if len(to) and lack[i, to].any():
                    overlap[i, to] = np.minimum(v, others).sum(1) / 3
        overlap = overlap[np.ix_(rows, columns)]
        weight = 0.75 * ~np.isnan(scene) + 0.25 * ~np.isnan(overlap)
        mixed = np.divide(0.75 * np.nan_to_num(scene) + 0.25 * np.nan_to_num(overlap), weight, out=np.full(common.shape, np.nan), where=weight > 0)
        at = np.ix_(rows, columns)
        found[at] = np.where(lack[at], mixed, found[at])
    return found


def mean_similarity(photos: DataFrame, *group: str, size: int = SIZE) -> DataFrame:
    """(group, photo_id, mean): the mean visual similarity of each photo to its group's others that it can be compared with; null without one."""
    kind = dict(photos.dtypes)["photo_id"]
    rows = photos.select(*group, "photo_id", vectors.doubles(F.col("embedding")).alias("embedding"), F.coalesce(texts.scene_tags(F.col("tags")), F.array().cast("array<string>")).alias("tags"), F.col("histogram").cast("array<double>").alias("histogram"))

    def pack(part: pd.DataFrame) -> dict:
        return {"id": part["photo_id"].to_numpy(), "tags": [[t for t in v if t is not None] for v in part["tags"]], "embedding": _rows_of(part["embedding"]), "histogram": _rows_of(part["histogram"])}

    def sums(x: dict, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"photo_id": x["id"], "total": np.nansum(s, 1), "n": (~np.isnan(s)).sum(1)})

    def compute(x: dict, y: dict | None) -> pd.DataFrame:
        s = similarity(x, x if y is None else y)
        if y is None:
            np.fill_diagonal(s, np.nan)
            return sums(x, s)
        return pd.concat([sums(x, s), sums(y, s.T)], ignore_index=True)

    found = tiled(rows, list(group), F.col("photo_id"), pack, compute, f"photo_id {kind}, total double, n long", size)
    return found.groupBy(*group, "photo_id").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))


__all__ = ["label_sums", "mean_similarity", "place_scales", "scales", "time_scales"]
