"""Queries on the pixels of pictures made from keys: hashes by resampling, pictures turned upright."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators import images, resampling
from darkroom.plans.analogs import dealt, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Level of channel c at a place of the picture of a key.
LEVEL = "((({k} % 7 + 1) * {x} * 5 + ({k} % 11) * {y} * 3 + ({k} % 5) * {x} * {y} + {c} * ({x} + 17 * ({k} % 13))) % 256)"


def rgb(key: str, width: Column, height: Column) -> Column:
    """Rows of RGB bytes by LEVEL."""

    def place(i: Column) -> Column:
        x, y, k = i % width, F.floor(i / width), F.col(key)
        level = lambda c: ((k % 7 + 1) * x * 5 + (k % 11) * y * 3 + (k % 5) * x * y + c * (x + 17 * (k % 13))) % 256
        return F.concat(*(F.lpad(F.hex(level(c).cast("long")), 2, "0") for c in range(3)))

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), width * height - 1), place), ""))


#: Pictures of hashed pictures: their bytes are the digits of as many digests of the key.
WIDE, HIGH = 36, 34
DIGESTS = -(-3 * WIDE * HIGH // 64)
_R, _G, _B = (f"ascii(substr(s, (y * {WIDE} + x) * 3 + {c}, 1))" for c in (1, 2, 3))


def _weights(n: int) -> str:
    """(o, i, w): whole weights of the windowed sinc from n places to 32."""
    return f"""(SELECT o, i, trunc(w / sum(w) OVER (PARTITION BY o) * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS w FROM (
    SELECT o, i, CASE WHEN t = 0 THEN 1.0 WHEN t < -3 OR t >= 3 THEN 0.0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END AS w FROM (
      SELECT o, i, (i - (o + 0.5::DOUBLE) * {n} / 32 + 0.5) / ({n}::DOUBLE / 32) AS t FROM range(32) a(o), range({n}) b(i)
      WHERE i >= trunc((o + 0.5::DOUBLE) * {n} / 32 - 3 * {n}::DOUBLE / 32 + 0.5) AND i < trunc((o + 0.5::DOUBLE) * {n} / 32 + 3 * {n}::DOUBLE / 32 + 0.5))))"""


@query(f"""WITH d AS (SELECT p_partkey, string_agg(sha256(p_partkey || ':' || i), '' ORDER BY i) AS s FROM part, range({DIGESTS}) n(i) GROUP BY 1),
p AS (SELECT p_partkey, x, y, (19595 * {_R} + 38470 * {_G} + 7471 * {_B} + 32768) // 65536 AS v FROM d, range({WIDE}) a(x), range({HIGH}) b(y)),
h AS (SELECT p_partkey, y, o AS x, greatest(0, least(255, floor((sum(v * w) + 2097152)::DOUBLE / 4194304)))::BIGINT AS v FROM p JOIN {_weights(WIDE)} ON i = x GROUP BY ALL),
s AS (SELECT p_partkey, x, o AS y, greatest(0, least(255, floor((sum(v * w) + 2097152)::DOUBLE / 4194304)))::BIGINT AS v FROM h JOIN {_weights(HIGH)} ON i = y GROUP BY ALL),
c AS (SELECT f, n, CASE WHEN f = 0 THEN sqrt(1 / 32) ELSE sqrt(2 / 32) * cos(pi() * (2 * n + 1) * f / 64) END AS a FROM range(8) a(f), range(32) b(n)),
r AS (SELECT p_partkey, y, f AS u, sum(v * a) AS v FROM s JOIN c ON n = x GROUP BY ALL), t AS (SELECT p_partkey, u, f AS k, round(sum(v * a), 6) AS v FROM r JOIN c ON n = y GROUP BY ALL),
m AS (SELECT p_partkey, median(v) AS m FROM t WHERE u + k > 0 GROUP BY 1)
SELECT p_partkey, printf('%08x%08x', coalesce(sum(1::BIGINT << (31 - (8 * k + u) % 32)) FILTER (k < 4 AND v > m), 0)::BIGINT, coalesce(sum(1::BIGINT << (31 - (8 * k + u) % 32)) FILTER (k >= 4 AND v > m), 0)::BIGINT) AS phash FROM t JOIN m USING (p_partkey) GROUP BY 1""")
def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of coloured pictures, resampled in whole numbers."""
    digest = F.transform(F.sequence(F.lit(0), F.lit(DIGESTS - 1)), lambda i: F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), i.cast("string")), 256))
    pixels = F.substring(F.encode(F.array_join(digest, ""), "UTF-8"), 1, 3 * WIDE * HIGH)
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"), pixels.alias("pixels"))
    return rows.select("p_partkey", images.hashes(F.col("width"), F.col("height"), F.col("pixels")).alias("phash"))


_TURNED = [LEVEL.format(k="k", x="x", y="y", c=c) for c in range(3)]


@query(f"""WITH f AS (SELECT p_partkey AS k, (p_partkey % 3 + 3)::INT AS w, (p_partkey % 4 + 2)::INT AS h, CASE WHEN p_partkey % 10 > 0 THEN p_partkey % 10 END AS o, p_partkey % 23 = 0 AS bad FROM part),
s AS (SELECT *, CASE WHEN NOT bad AND o BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN NOT bad AND o BETWEEN 5 AND 8 THEN w ELSE h END AS height FROM f),
p AS (SELECT k, a, b, CASE o WHEN 2 THEN w - 1 - a WHEN 3 THEN w - 1 - a WHEN 5 THEN b WHEN 6 THEN b WHEN 7 THEN w - 1 - b WHEN 8 THEN w - 1 - b ELSE a END AS x,
  CASE o WHEN 3 THEN h - 1 - b WHEN 4 THEN h - 1 - b WHEN 5 THEN a WHEN 6 THEN h - 1 - a WHEN 7 THEN h - 1 - a WHEN 8 THEN a ELSE b END AS y FROM s, range(5) i(a), range(5) j(b) WHERE NOT bad AND a < width AND b < height),
t AS (SELECT k, string_agg(printf('%02x%02x%02x', {", ".join(_TURNED)}), '' ORDER BY b, a) AS pixels FROM p GROUP BY 1)
SELECT k AS p_partkey, width, height, pixels FROM s LEFT JOIN t USING (k)""")
def upright_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures turned as their orientations ask; some have none, an unknown one or no pixels."""
    k = F.col("p_partkey")
    w, h = (k % 3 + 3).cast("int"), (k % 4 + 2).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), F.when(k % 10 > 0, k % 10).alias("o"), F.when(k % 23 > 0, rgb("p_partkey", w, h)).alias("pixels"))
    return resampling.upright(rows, F.col("o")).select("p_partkey", "width", "height", F.lower(F.hex("pixels")).alias("pixels"))
