"""Faces in photos: which boxes stay, which landmarks belong to them, and sums by photo. Detections are inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.operators.images import overlap

BOX = "struct<x:double,y:double,width:double,height:double>"


def suppressed(faces: DataFrame, *by: str, at: float = 0.35) -> DataFrame:
    """Of boxes that overlap by that share or more, those of the highest score; equal scores by id.

    faces(*by, face, score, box BOX); a photo's boxes are few and are folded in one expression."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "face", "box", "score")))
    none = F.filter(F.col("all"), lambda f: F.lit(False))
    stay = F.aggregate("all", none, lambda kept, f: F.when(F.exists(kept, lambda k: overlap(k["box"], f["box"]) >= at), kept).otherwise(F.concat(kept, F.array(f))))
    out = faces.where(F.col("score").isNotNull() & F.col("box").isNotNull()).groupBy(*by).agg(ordered.alias("all")).select(*by, F.explode(stay).alias("f"))
    return out.select(*by, "f.face", "f.score", "f.box")


def matched(faces: DataFrame, landmarks: DataFrame, *by: str, least: float = 0.15) -> DataFrame:
    """(*by, face, landmark, share): for each face the landmarks whose box covers it best, if by that share; the smaller id of equals.

    An equal join by photo, so what meets is a photo's faces and landmarks."""
    pairs = faces.select(*by, "face", "box").join(landmarks.select(*by, "landmark", F.col("box").alias("other")), list(by))
    share = pairs.withColumn("share", overlap(F.col("box"), F.col("other"))).where(F.col("share") >= least)
    best = share.groupBy(*by, "face").agg(F.max(F.struct("share", (-F.col("landmark")).alias("m"))).alias("b"))
    return best.select(*by, "face", (-F.col("b.m")).alias("landmark"), "b.share")


# fixed values: photos whose longer side exceeds this are looked at in parts, unless a face's shorter side has that many pixels; a part's share of each side
LARGE_SIDE, FACE_SIDE, PART = 2400, 96, 0.6


def tiles(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(photo_id, left, top, tile_width, tile_height, width, height): overlapping parts at the corners of large photos in which no clear face was found, in pixels.

    photos(photo_id, width, height), faces(photo_id, box BOX) as shares of the frame."""
    side = F.least(F.col("box.width") * F.col("width"), F.col("box.height") * F.col("height"))
    clear = faces.join(photos.select("photo_id", "width", "height"), "photo_id").groupBy("photo_id").agg(F.max(side).alias("side"))
    wanted = photos.join(clear, "photo_id", "left").where((F.greatest("width", "height") > LARGE_SIDE) & ~F.coalesce(F.col("side") >= FACE_SIDE, F.lit(False)))
    # halves go to the even number
    part = lambda c: F.least(F.col(c), F.bround(F.col(c) * F.lit(PART), 0).cast("int"))
    sized = wanted.select("photo_id", "width", "height", part("width").alias("tile_width"), part("height").alias("tile_height"))
    starts = lambda c: F.explode(F.array_distinct(F.array(F.lit(0), F.col(c) - F.col(f"tile_{c}"))))
    return sized.withColumn("left", starts("width")).withColumn("top", starts("height")).select("photo_id", "left", "top", "tile_width", "tile_height", "width", "height")


def in_frame(found: DataFrame) -> DataFrame:
    """Faces found in tiles, with their boxes moved to the frame: found has the columns of tiles() and face, score, box as shares of the tile."""
    move = lambda axis, start, size: (F.col(start) + F.col(f"box.{axis}") * F.col(f"tile_{size}")) / F.col(size)
    grow = lambda size: F.col(f"box.{size}") * F.col(f"tile_{size}") / F.col(size)
    box = F.struct(move("x", "left", "width").alias("x"), move("y", "top", "height").alias("y"), grow("width").alias("width"), grow("height").alias("height"))
    return found.select("photo_id", "face", "score", box.alias("box"))


def detected_by_tiles(photos: DataFrame, detect, at: float = 0.35) -> DataFrame:
    """(photo_id, face, score, box) of what detect finds in whole photos and, where tiles() asks for it, in their parts; of faces that overlap across parts the surest stays.

    detect(parts) -> parts with face, score and box as shares of the part, a row for each face; ids are a photo's own over all its parts. Parts have the columns of tiles()."""
    whole = photos.select("photo_id", F.lit(0).alias("left"), F.lit(0).alias("top"), F.col("width").alias("tile_width"), F.col("height").alias("tile_height"), "width", "height")
    first = in_frame(detect(whole))
    return suppressed(first.unionByName(in_frame(detect(tiles(photos, first)))), "photo_id", at=at)


def from_letterbox(found: DataFrame, size: int = 416, least: float = 0.70) -> DataFrame:
    """(photo_id, face, score, box): corners that a detector gave for a square canvas, in which the photo was centred, as boxes in the photo, cut at its edges.

    found(photo_id, face, score, x1, y1, x2, y2, width, height); corners are pixels of the canvas, or shares of it where none exceeds 2.5. Faces below `least` and those without extent go."""
    scale = F.least(size / F.col("width"), size / F.col("height"))
    fitted = {a: F.greatest(F.lit(1), F.bround(F.col(a) * scale, 0).cast("int")) for a in ("width", "height")}
    shares = F.greatest(*(F.abs(F.col(c)) for c in ("x1", "y1", "x2", "y2"))) <= 2.5

    def at(c: str, a: str) -> F.Column:
        pad = F.floor((size - fitted[a]) / 2)
        return F.least(F.greatest((F.when(shares, F.col(c) * size).otherwise(F.col(c)) - pad) / fitted[a], F.lit(0.0)), F.lit(1.0))

    corners = found.where(F.col("score") >= least).select("photo_id", "face", "score", *(at(c, "width" if c[0] == "x" else "height").alias(c) for c in ("x1", "y1", "x2", "y2")))
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return corners.where("x2 > x1 AND y2 > y1").select("photo_id", "face", "score", box.alias("box"))


def summary(faces: DataFrame, *by: str) -> DataFrame:
    """Counts of a photo's faces and the 20th percentile of their clarity; 'high_value' ones count faces that merit a review.

    faces(*by, clarity, severity, closed_eye, edge_crop, occlusion, eligible)."""
    n = F.count_if
    worth = F.coalesce("eligible", F.lit(False))
    flags = ("closed_eye", "edge_crop", "occlusion")
    return faces.groupBy(*by).agg(
        F.count("*").alias("detected"), F.count("clarity").alias("analyzed"), F.round(F.coalesce(F.percentile("clarity", 0.2), F.lit(0.0)), 4).alias("clarity_p20"),
        *(n(F.col(c)).alias(c) for c in flags), *(n(F.col(c) & worth).alias(f"high_value_{c}") for c in flags), n(worth & F.col("severity").eqNullSafe("severe")).alias("high_value_blur"),
    )
