"""Scores from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, level outside them; null for null."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


#: Similarity by hours and by kilometres between neighbours.
# fixed values: likeness by hours and by kilometres between photos
BY_HOURS = [(0.0, 1.0), (6.0, 1.0), (24.0, 0.7), (72.0, 0.3), (336.0, 0.0)]
BY_KM = [(0.0, 1.0), (5.0, 1.0), (50.0, 0.4), (300.0, 0.0)]


def weighted(parts: list[tuple[Column, float]], otherwise: float | None = None) -> Column:
    """Mean of the parts that are present, by weights among these."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(F.lit(otherwise))


def saturating(gap: Column, scale: Column) -> Column:
    """gap / (gap + scale)."""
    return gap / (gap + scale)


def ratio(part: Column, whole: Column, otherwise: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; both 1 without cases."""
    p, zz = hits / n, z * z
    centre, width = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, clamp(centre - width)).otherwise(1.0), F.when(n > 0, clamp(centre + width)).otherwise(1.0)


def positive_similarity(raw: Column, expanded: Column) -> Column:
    """Of a query and the mean of its expansions; without expansions the query's own."""
    return 0.7 * raw + 0.3 * F.coalesce(expanded, raw)


def signal(positive: Column, negative: Column) -> Column:
    """Similarity less half of what a negative exceeds it by; a negative of exactly 0 counts as absent."""
    return positive - 0.5 * F.greatest(F.lit(0.0), F.coalesce(F.nullif(negative, F.lit(0.0)), F.lit(-1.0)) - positive)


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Between knots, level outside, within 0 and 1."""
    return clamp(piecewise(x, list(zip(xs, ys, strict=True))))


def logistic(features: list[tuple[Column, float, float, float]], intercept: float) -> Column:
    """Of standardised features (column, mean, scale, weight); a missing one counts as its mean."""
    z = sum((F.coalesce((c - m) / s, F.lit(0.0)) * w for c, m, s, w in features), F.lit(intercept))
    return 1 / (1 + F.exp(-clamp(z, -40.0, 40.0)))
