"""Arithmetic on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def normalized(v: Column) -> Column:
    """Unit vector; null for null, empty, zero and non-finite vectors."""
    n = norm(v)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) > 0) & ~odd & (n > 0), F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of unit vectors, within ±1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2 of unit vectors, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - dot(a, b)) / 2))


def shares(v: Column) -> Column:
    """v divided by its sum; null if that isn't positive."""
    total = _sum(v)
    return F.when(total > 0, F.transform(v, lambda x: x / total))


def hellinger(p: Column, q: Column) -> Column:
    """Hellinger distance of two distributions."""
    return F.when(F.size(p) == F.size(q), F.sqrt(_sum(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), 2))) / 2))


def histogram_distance(p: Column, q: Column) -> Column:
    """Half the mean L1 distance of three-channel histograms."""
    return F.when((F.size(p) == F.size(q)) & (F.size(p) > 0), _sum(F.zip_with(p, q, lambda x, y: F.abs(x - y))) / 6)


def histogram_overlap(p: Column, q: Column, channels: int = 3) -> Column:
    """Intersection of histograms, by channel."""
    return F.when((F.size(p) == F.size(q)) & (F.size(p) > 0), _sum(F.zip_with(p, q, lambda x, y: F.least(x, y))) / channels)


def sign_bits(v: Column) -> Column:
    """A string of 0 and 1: 1 where a component is positive."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hexadecimal, of up to 16 digits; null without a hash."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long"))).cast("int"))
