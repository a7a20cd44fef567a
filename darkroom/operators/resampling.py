"""Pictures of 8 bits a channel, made smaller or larger by windowed filters in whole numbers, and turned upright.

A row of weights belongs to each output place: the filter, stretched by the scale where the picture shrinks, over the places it covers, of sum 1, in
units of 2^-22. Columns are made first and rounded to 8 bits, then rows. This follows the arithmetic of the common imaging library of
Python, so that pictures, hashes and measures can be compared with those made from its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22


def windowed_sinc(x: np.ndarray) -> np.ndarray:
    """Three lobes of sinc(x), under the first of sinc(x / 3)."""
    return np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0.0)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


#: Filters with the distance at which they end.
FILTERS = {"sinc": (windowed_sinc, 3.0), "linear": (triangle, 1.0)}


@lru_cache(maxsize=64)
def weights(n: int, out: int, name: str, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Of `out` places over the first `length` of n: the first place each takes from, and its whole weights (out x taps)."""
    shape, reach = FILTERS[name]
    scale = length / out
    stretch = max(scale, 1.0)
    middle = (np.arange(out) + 0.5) * scale
    first = np.maximum((middle - reach * stretch + 0.5).astype(int), 0)
    count = np.minimum((middle + reach * stretch + 0.5).astype(int), n) - first
    tap = np.arange(count.max())
    w = np.where(tap < count[:, None], shape((tap + first[:, None] - middle[:, None] + 0.5) / stretch), 0.0)
    total = w.cumsum(1)[:, -1:]
    w = w / np.where(total == 0, 1.0, total) * 2**BITS
    return first, np.trunc(w + np.copysign(0.5, w)).astype(np.int32)


def along_rows(x: np.ndarray, out: int, name: str, length: float) -> np.ndarray:
    """x (height, width, channels) with `out` rows."""
    first, w = weights(x.shape[0], out, name, length)
    if out < w.shape[1]:
        # few places of many taps: a product each, exact in double precision
        flat = x.reshape(len(x), -1)
        lines = [k[: len(x) - f].astype(float) @ flat[f : f + len(k)].astype(float) for f, k in zip(first, w, strict=True)]
        total = np.stack(lines).astype(np.int64).reshape(out, *x.shape[1:]) + (1 << (BITS - 1))
    else:
        total = np.full((out, *x.shape[1:]), 1 << (BITS - 1), np.int32)
        for t in range(w.shape[1]):
            total += w[:, t, None, None] * x[np.minimum(first + t, x.shape[0] - 1)]
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def resized(x: np.ndarray, width: int, height: int, name: str = "sinc", box: tuple[float, float] | None = None) -> np.ndarray:
    """x (uint8; height, width and perhaps channels) at another size. box: the part of it that is meant, from its first corner."""
    across, down = box or (x.shape[1], x.shape[0])
    y = x if x.ndim == 3 else x[..., None]
    if (width, float(width)) != (y.shape[1], across):
        y = along_rows(np.ascontiguousarray(y.swapaxes(0, 1)), width, name, across).swapaxes(0, 1)
    if (height, float(height)) != (y.shape[0], down):
        y = along_rows(np.ascontiguousarray(y), height, name, down)
    return y if x.ndim == 3 else y[..., 0]


def averaged(x: np.ndarray, across: int, down: int) -> np.ndarray:
    """x by averages of cells of across x down; the last ones may be smaller. Sums are multiplied by the reciprocal of the size, in single precision and cut
    to units of 2^-24, so a mean just above a half may be rounded down."""
    h, w = x.shape[:2]
    whole = np.pad(x, ((0, -h % down), (0, -w % across)) + ((0, 0),) * (x.ndim - 2))
    total = sum((whole[i::down, j::across].astype(np.int32) for i in range(down) for j in range(across)), np.int32(0))
    size = np.minimum(down, h - np.arange(0, h, down))[:, None] * np.minimum(across, w - np.arange(0, w, across))
    size = size if x.ndim == 2 else size[..., None]
    share = (np.float32(1 << 24) / size.astype(np.float32)).astype(np.int64)
    return ((total.astype(np.int64) + size // 2) * share >> 24).astype(np.uint8)


def fitting(width: int, height: int, edge: int) -> tuple[int, int]:
    """The size within edge x edge whose proportions come closest; a smaller picture stays."""
    if max(width, height) <= edge:
        return width, height
    aspect = width / height

    def whole(v: float, off) -> int:
        return max(1, min(floor(v), ceil(v), key=off))

    if aspect <= 1:
        return whole(edge * aspect, lambda n: abs(aspect - n / edge)), edge
    return edge, whole(edge / aspect, lambda n: abs(aspect - edge / n) if n else 0)


def thumbnail(x: np.ndarray, edge: int, name: str = "sinc") -> np.ndarray:
    """x within edge x edge; cells are averaged first where it has more than four times as many pixels a side as are asked for."""
    h, w = x.shape[:2]
    width, height = fitting(w, h, edge)
    if (width, height) == (w, h):
        return x
    across, down = max(1, int(w / width / 2)), max(1, int(h / height / 2))
    small = averaged(x, across, down) if max(across, down) > 1 else x
    return resized(small, width, height, name, (w / across, h / down))


def long_edge(x: np.ndarray, edge: int, name: str = "sinc") -> np.ndarray:
    """x with its long side at most `edge`, sides rounded to the nearest."""
    h, w = x.shape[:2]
    if max(h, w) <= edge:
        return x
    return resized(x, max(1, round(w * (edge / max(h, w)))), max(1, round(h * (edge / max(h, w)))), name)


def turned(x: np.ndarray, orientation: int | None) -> np.ndarray:
    """x as an EXIF orientation of 1 to 8 asks to see it; others leave it as it is."""
    if orientation in (5, 6, 7, 8):
        x = x.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        x = x[:, ::-1]
    return x[::-1] if orientation in (3, 4, 7, 8) else x


def pixels_of(raw: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """(height, width, 3) of rows of RGB bytes; none if there are none, or not as many as the size tells."""
    if raw is None or pd.isna(width) or pd.isna(height) or width <= 0 or height <= 0 or len(raw) != 3 * int(width) * int(height):
        return None
    return np.frombuffer(raw, np.uint8).reshape(int(height), int(width), 3)


def upright(pixels: DataFrame, orientation: Column) -> DataFrame:
    """pixels(width, height, pixels, ...) turned as the orientation asks. Pictures of orientation 1, null or unknown don't leave the JVM; unreadable ones
    (null, or not as many bytes as the size tells) have null pixels and keep their size."""

    @F.pandas_udf("width int, height int, pixels binary")
    def turn(w: pd.Series, h: pd.Series, raw: pd.Series, way: pd.Series) -> pd.DataFrame:
        def rows() -> Iterator[tuple]:
            for a, b, r, o in zip(w, h, raw, way, strict=True):
                x = pixels_of(r, a, b)
                y = turned(x, int(o)) if x is not None and not pd.isna(o) else None
                yield (a, b, None) if y is None else (y.shape[1], y.shape[0], y.tobytes())

        return pd.DataFrame(list(rows()), columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    needed = F.coalesce(orientation.between(2, 8), F.lit(False))
    whole = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.length("pixels") == 3 * F.col("width").cast("long") * F.col("height")), F.lit(False))
    part = lambda c: F.when(needed & whole, F.col(c))
    made = pixels.withColumn("_turned", F.when(needed & whole, turn(part("width"), part("height"), part("pixels"), F.when(needed & whole, orientation))))
    return made.withColumns({
        "width": F.coalesce("_turned.width", "width"), "height": F.coalesce("_turned.height", "height"),
        "pixels": F.when(whole, F.coalesce("_turned.pixels", "pixels")),
    }).drop("_turned")
