"""Sizes from file headers, and limits of uploads."""

import struct

from darkroom.sources import media


def jpeg(width, height, before=0):
    """Only markers: so many segments of the largest size, then a frame header."""
    segment = b"\xff\xe1" + struct.pack(">H", 65535) + bytes(65533)
    return b"\xff\xd8" + segment * before + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", height, width) + bytes(20)


def heic(*sizes):
    boxes = b"".join(struct.pack(">I4sIII", 20, b"ispe", 0, w, h) for w, h in sizes)
    return struct.pack(">I", 16) + b"ftypheic" + bytes(4) + struct.pack(">I", 8 + len(boxes)) + b"meta" + boxes


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def whole_heic(*sizes, before=0, data=b""):
    """Extents among the properties of items, as cameras write them, with other boxes before and picture data after."""
    ispe = [box(b"ispe", bytes(4), struct.pack(">II", w, h)) for w, h in sizes]
    meta = box(b"meta", bytes(4), box(b"hdlr", bytes(24)), box(b"free", bytes(before)), box(b"iprp", box(b"ipco", box(b"colr", b"nclx"), *ispe), box(b"ipma", bytes(8))))
    return box(b"ftyp", b"heic", bytes(4)) + meta + box(b"mdat", data)


#: Picture data that looks like an extent.
FALSE = b"....ispe" + bytes(4) + struct.pack(">II", 30_000, 30_000)

FILES = {
    "camera.heic": (whole_heic((512, 512), (4032, 3024), data=FALSE * 5), (4032, 3024), None),
    "late.heic": (whole_heic((512, 512), (4032, 3024), before=200_000, data=FALSE), (4032, 3024), None),
    "torn.heic": (whole_heic((512, 512))[:60], (None, None), "unreadable"),
    "parted.heic": (box(b"ftyp", b"heic", bytes(4)) + box(b"mdat", FALSE * 9000) + whole_heic((640, 480))[16:], (640, 480), None),
    "filled.jpg": (b"\xff\xd8\xff\xff\xff\xe0\x00\x04ab\xff\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", 30, 40) + bytes(20), (40, 30), None),
    "a.jpg": (jpeg(40, 30), (40, 30), None),
    "late.jpg": (jpeg(16384, 16384, before=3), (16384, 16384), "too_many_pixels"),
    "a.png": (b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 7, 5), (7, 5), None),
    "huge.png": (b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 2**31 + 5, 5), (None, 5), "unreadable"),
    "a.gif": (b"GIF89a" + struct.pack("<HH", 300, 2), (300, 2), None),
    "down.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 640, -480), (640, 480), None),
    "huge.bmp": (b"BM" + bytes(16) + struct.pack("<Ii", 2**31 + 1, 5), (None, 5), "unreadable"),
    "x.webp": (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + struct.pack("<I", 9999)[:3] + struct.pack("<I", 7999)[:3], (10000, 8000), "too_many_pixels"),
    "l.webp": (b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 99 | 49 << 14), (100, 50), None),
    "y.webp": (b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 176, 144), (176, 144), None),
    "a.heic": (heic((64, 64), (4032, 3024), (320, 240)), (4032, 3024), None),
    "big.heic": (heic((64, 64), (9000, 9000)), (9000, 9000), "too_many_pixels"),
    "odd.jpg": (b"\xff\xd8nothing", (None, None), "unreadable"),
    "none.png": (b"", (None, None), "empty"),
    "a.tiff": (jpeg(4, 4), (4, 4), "unsupported_type"),
}


def test_sizes_and_limits(spark):
    rows = spark.createDataFrame([(k, v[0], len(v[0]), "b") for k, v in FILES.items()], "path string, content binary, length long, batch string")
    for head in (64, 65536):
        got = {r.path: ((r.width, r.height), r.reason) for r in media.checked(media.with_sizes(rows, head), "batch").collect()}
        assert got == {k: v[1:] for k, v in FILES.items()}


def test_declared_types(spark):
    rows = spark.createDataFrame([("a.jpg", 5, 4, 4, "b", t) for t in ("image/jpeg", "IMAGE/PNG", "text/html", None)], "path string, length long, width int, height int, batch string, type string")
    assert [(r.type, r.reason) for r in media.checked(rows, "batch", "type").collect()] == [("image/jpeg", None), ("IMAGE/PNG", None), ("text/html", "unsupported_type"), (None, "unsupported_type")]
