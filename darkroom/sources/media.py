"""Media files: ingest with limits, and sizes from file headers without decoding pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values
SUFFIXES = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "heic")
MOST_BYTES, MOST_BATCH_BYTES, MOST_FILES, MOST_PIXELS = 20 << 20, 200 << 20, 200, 60_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, content of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumnRenamed("modificationTime", "modified")


def header_size(content: Column) -> Column:
    """(width, height) of PNG, GIF, BMP and WEBP from their first bytes; null for others, and for sizes that no int holds. JPEG, HEIC: image_size()."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).try_cast("int")
    swapped = lambda at, n: F.conv(F.concat(*(F.lpad(F.hex(F.substring(content, at + i, 1)), 2, "0") for i in reversed(range(n)))), 16, 10).try_cast("long")
    # heights of bitmaps are signed: negative ones are stored from the top
    signed = lambda at: F.abs(F.when(swapped(at, 4) >= 1 << 31, swapped(at, 4) - (1 << 32)).otherwise(swapped(at, 4)))
    size = lambda w, h: F.struct(w.try_cast("int").alias("width"), h.try_cast("int").alias("height"))
    head, kind = F.hex(F.substring(content, 1, 12)), F.decode(F.substring(content, 13, 4), "ISO-8859-1")
    packed, low14 = swapped(22, 4), F.lit((1 << 14) - 1)
    webp = (
        F.when(kind == "VP8X", size(swapped(25, 3) + 1, swapped(28, 3) + 1))
        .when(kind == "VP8L", size(packed.bitwiseAND(low14) + 1, F.shiftright(packed, 14).bitwiseAND(low14) + 1))
        .when(kind == "VP8 ", size(swapped(27, 2).bitwiseAND(low14), swapped(29, 2).bitwiseAND(low14)))
    )
    return (
        F.when(head.startswith("89504E470D0A1A0A"), size(number(17, 4), number(21, 4)))
        .when(head.startswith("474946"), size(swapped(7, 2), swapped(9, 2)))
        .when(head.startswith("424D"), size(swapped(19, 4), signed(23)))
        .when(head.startswith("52494646") & head.endswith("57454250"), webp)
    )


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG; bytes that fill up before a marker are skipped."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:  # stand alone
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def boxes(content: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes of a part of a file, by their sizes; one that runs over the end comes last, with its own end."""
    at = start
    while at + 8 <= end:
        size, kind, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
        stop = end if size == 0 else at + size
        if size and size < head:
            return
        yield kind, at + head, stop
        at = stop


def heic_size(content: bytes) -> tuple[int, int] | None:
    """The largest of the spatial extents that a HEIC file's items have: from the properties in its meta box, which must be there to its end. Bytes of pictures are not looked at."""
    if content[4:8] != b"ftyp":
        return None
    found = []

    def extents(start: int, end: int) -> None:
        for kind, at, stop in boxes(content, start, end):
            if kind in (b"iprp", b"ipco"):
                extents(at, min(stop, end))
            elif kind == b"ispe" and at + 12 <= min(stop, end):
                found.append(struct.unpack(">II", content[at + 4 : at + 12]))

    for kind, at, stop in boxes(content, 0, len(content)):
        if kind == b"meta":
            if stop > len(content):
                return None
            # version and flags come first, but for writers that leave them out
            extents(at if content[at + 4 : at + 8].isalpha() else at + 4, stop)
            break
    return max(found, key=lambda s: s[0] * s[1], default=None)


def with_sizes(rows: DataFrame, head_bytes: int = 65536) -> DataFrame:
    """rows(path, content, ...) with width and height, null if the file does not tell.

    Of a JPEG or HEIC the first bytes go to Python, and the whole file only where these do not hold its whole header, so that what is found does not depend on head_bytes."""

    @F.pandas_udf("width int, height int")
    def sized(parts: pd.Series) -> pd.DataFrame:
        fits = lambda s: s if s and max(s) < 1 << 31 else (None, None)
        found = [fits(jpeg_size(h) or heic_size(h)) if h is not None else (None, None) for h in parts]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    in_python = (F.hex(F.substring("content", 1, 2)) == "FFD8") | (F.substring("content", 5, 4) == F.lit(b"ftyp"))
    short = rows.withColumn("_size", F.coalesce(header_size(F.col("content")), sized(F.when(in_python, F.substring("content", 1, head_bytes)))))
    more = in_python & F.col("_size.width").isNull() & (F.length("content") > head_bytes)
    # asNondeterministic: evaluated once, after the first
    whole = short.withColumn("_more", sized.asNondeterministic()(F.when(more, F.col("content"))))
    return whole.withColumns({c: F.coalesce(f"_size.{c}", f"_more.{c}") for c in ("width", "height")}).drop("_size", "_more")


def checked(rows: DataFrame, batch: str, content_type: str | None = None) -> DataFrame:
    """rows(path, length, width, height, batch) with reason: null if accepted, else why a file is refused.

    content_type: the column of the declared type, which must be an image's, if given. A file without a size is refused, as the limit of
    pixels could not be checked. Files of a batch count in order of their paths, those refused for themselves don't count."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    declared = F.coalesce(F.lower(F.col(content_type)).startswith("image/"), F.lit(False)) if content_type else F.lit(True)
    own = (
        F.when(~suffix.isin(*SUFFIXES) | ~declared, "unsupported_type").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large")
        .when(F.col("width").isNull() | F.col("height").isNull() | (F.least("width", "height") <= 0), "unreadable").when(F.col("width").cast("long") * F.col("height") > MOST_PIXELS, "too_many_pixels")
    )
    run = Window.partitionBy(batch).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_own", own).withColumns({"_files": F.sum(F.col("_own").isNull().cast("int")).over(run), "_bytes": F.sum(F.when(F.col("_own").isNull(), F.col("length")).otherwise(0)).over(run)})
    reason = F.coalesce("_own", F.when(F.col("_files") > MOST_FILES, "too_many_files").when(F.col("_bytes") > MOST_BATCH_BYTES, "batch_too_large"))
    return counted.withColumn("reason", reason).drop("_own", "_files", "_bytes")


def decoded(rows: DataFrame, decode) -> DataFrame:
    """rows(path, content) with features from an injected decoder: decode(bytes) -> dict(width, height, features) or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode(c) or {} for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "width": [g.get("width") for g in got], "height": [g.get("height") for g in got], "features": [g.get("features") for g in got], "failed": [not g for g in got]})

    return rows.select("path", "content").mapInPandas(run, "path string, width int, height int, features map<string,double>, failed boolean")


def upright(width: Column, height: Column, orientation: Column) -> Column:
    """(width, height) after the turn that an EXIF orientation asks for: 5 to 8 swap the sides."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))
